"""URL verdicts from rules and from the link graph of hosts (dealt operator 6).

Hosts that the rules allow pages of are trusted seeds, hosts with blocked pages are distrusted ones. Trust flows
along links (personalised PageRank), distrust against them; a host whose distrust outweighs its trust by the
threshold, both in proportion to its own mass in the same flow, is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host tables up to this many rows are broadcast; larger ones are joined by shuffle.
SMALL = 100_000
#: Quoted or bare link targets with a host of their own; the others stay on their page's host.
LINKS = r"""(?i)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) for a host, its subdomains and the beginning of a path, as a struct
    (rule, verdict); null if none fits. ``rules`` is a short list: each is one test."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: source, target, links. Counted map-side, so a hot host sends few rows."""
    urls = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINKS), F.lit(1))
    rows = pages.select("host", F.explode(urls).alias("url")).where("host <> ''")
    target = F.translate(F.regexp_extract("url", r"//([^/?#]*)", 1), UPPER, LOWER)
    rows = rows.select(F.col("host").alias("source"), target.alias("target")).where("target <> '' and target <> source")
    return rows.groupBy("source", "target").agg(F.count("*").alias("links"))


def flow(seeds: DataFrame, edges: DataFrame, values: list[str], damping: float, rounds: int, tolerance: float) -> DataFrame:
    """Personalised PageRank of each of ``values`` in ``seeds`` (host, values) over ``edges`` (source, target, share).
    A host without links keeps what it would pass on. Ends when no value moves by more than ``tolerance``."""
    ranks = seeds
    open_hosts = edges.select(F.col("source").alias("host")).distinct().withColumn("passes", F.lit(True))
    fixed = stored(seeds.join(open_hosts, "host", "left").withColumn("passes", F.coalesce("passes", F.lit(False))))
    for _ in range(rounds):
        sent = edges.join(ranks.withColumnRenamed("host", "source"), "source")
        sent = sent.groupBy(F.col("target").alias("host")).agg(*[F.sum(F.col(v) * F.col("share")).alias(f"in_{v}") for v in values])
        base = fixed.select("host", "passes", *[F.col(v).alias(f"seed_{v}") for v in values])
        rows = base.join(ranks, "host").join(sent, "host", "left")
        new = [
            ((1 - damping) * F.col(f"seed_{v}") + damping * (F.coalesce(F.col(f"in_{v}"), F.lit(0.0)) + F.when(F.col("passes"), 0.0).otherwise(F.col(v)))).alias(f"new_{v}")
            for v in values
        ]
        rows = stored(rows.select("host", *values, *new))
        moved = rows.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"new_{v}") - F.col(v)) for v in values]))).first()[0]
        ranks = rows.select("host", *[F.col(f"new_{v}").alias(v) for v in values])
        if moved is None or moved <= tolerance:
            break
    return ranks


def shares(links: DataFrame, source: str, target: str) -> DataFrame:
    """Edges in one direction, each with its share of what its source passes on."""
    out = links.groupBy(source).agg(F.sum("links").alias("all"))
    return links.join(out, source).select(F.col(source).alias("source"), F.col(target).alias("target"), (F.col("links") / F.col("all")).alias("share"))


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    threshold: float = 0.5,
    damping: float = 0.85,
    rounds: int = 20,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) with host, path, rule, verdict, trust and distrust of its host.

    A fitting rule gives the verdict; else the host's: ``block`` where distrust minus trust exceeds ``threshold``.
    Trust is the mass that reaches a host from allowed pages, as a share of the mass that reaches it from all
    pages; distrust is the same for blocked pages with all links reversed. Without links they are the shares of
    the host's own pages. Hosts that are only linked to take part in the flow with no mass of their own.

    Null urls, and urls without ``://``, have an empty host and path, no rule and are allowed. Null html has no
    links. Repeated rows stay. Extra columns are ignored. Empty input gives no rows."""
    url = F.coalesce(F.col("url"), F.lit(""))
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    pages = pages.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    links = stored(host_links(pages))
    verdict = F.col("fit.verdict")
    known = pages.where("host <> ''").groupBy("host").agg(
        F.count("*").cast("double").alias("mass"),
        F.count(F.when(verdict == "allow", 1)).cast("double").alias("good"),
        F.count(F.when(verdict == "block", 1)).cast("double").alias("bad"),
    )
    linked = links.select(F.col("target").alias("host")).distinct()
    hosts = stored(known.join(linked, "host", "full").na.fill(0.0, ["mass", "good", "bad"]))
    forward = flow(hosts.select("host", "mass", "good"), shares(links, "source", "target"), ["mass", "good"], damping, rounds, tolerance)
    backward = flow(hosts.select("host", "mass", "bad"), shares(links, "target", "source"), ["mass", "bad"], damping, rounds, tolerance)
    share = lambda part: F.when(F.col("mass") > 0, F.col(part) / F.col("mass")).otherwise(F.lit(0.0))
    trust = forward.select("host", share("good").alias("trust"))
    distrust = backward.select("host", share("bad").alias("distrust"))
    judged = stored(trust.join(distrust, "host").select("host", "trust", "distrust"))
    small = judged.count() <= SMALL
    rows = pages.drop("html").join(F.broadcast(judged) if small else judged, "host", "left")
    by_host = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
