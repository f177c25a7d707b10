"""Mixing sources to target weights (dealt operator 10).

A token budget is passed down a tree of levels (domain, language, source). At each node the children share their
parent's budget by weight; a child that cannot use its share, with all its epochs, leaves the rest to its siblings,
and only what a whole family cannot use goes to the family's own siblings. Each leaf then gives whole epochs of
its rows and a token prefix of one more, each epoch in an order of its own drawn from the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.llm.store import stored

#: Leaf tables up to this many rows are broadcast; larger ones are joined by shuffle.
SMALL = 50_000
#: Hex digits of the seeded order by which the rows of a leaf are spread over tasks.
SPREAD = 3


def weight_of(weights: dict[tuple[str, ...], int], path: list[str]) -> Column:
    """The weight of a node by its path; nodes not listed weigh 1."""
    key = F.concat_ws("/", *path)
    found = F.lit(1)
    for node, weight in sorted(weights.items()):
        if len(node) == len(path):
            found = F.when(key == "/".join(node), weight).otherwise(found)
    return found.cast("long")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (weight, most, parent_budget) with ``budget``: the parent's budget by weight, no child above
    ``most``. Children are filled from the one that its weight fills first; the first that is not filled, and all
    after it, share what is left by weight, rounded down."""
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = family.orderBy(F.col("most") / F.col("weight"), name)
    rows = children.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("heavier", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("filled", F.col("most") * F.col("heavier") <= F.col("weight") * F.col("left"))
    open_ = F.when(~F.col("filled"), F.struct("left", "heavier"))
    rows = rows.withColumn("open", F.first(open_, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    part = F.expr("weight * open.left div open.heavier")
    return rows.withColumn("budget", F.when(F.col("filled"), F.col("most")).otherwise(part)).drop("left", "heavier", "filled", "open", "parent_budget")


def budgets(supply: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], total: int, max_epochs: int) -> DataFrame:
    """``supply`` (levels, tokens) with ``budget``, level by level from the top."""
    above = None
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        nodes = supply.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("long").alias("most"))
        nodes = nodes.withColumn("weight", weight_of(weights, path))
        nodes = nodes.join(above, parent) if parent else nodes.withColumn("parent_budget", F.lit(total).cast("long"))
        shared = shared_out(nodes, parent, levels[depth - 1])
        above = shared.select(*path, F.col("budget").alias("parent_budget"))
    return supply.join(above.withColumnRenamed("parent_budget", "budget"), levels)


def seeded(epoch: Column, doc_id: Column, seed: int) -> Column:
    """A row's place in an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[tuple[str, ...], int],
    budget_share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 5,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per epoch that takes them, with the columns ``mix_<level>``,
    ``epoch`` (from 0), ``tokens`` and ``leaf_budget``.

    The budget is ``budget_share`` of all tokens (words). A leaf whose budget is ``k`` times its supply and a rest
    gives epochs 0 to k-1 whole, and of epoch k, in seeded order, the rows that begin before the rest is used up.
    No leaf repeats a row more than ``max_epochs`` times. Integer arithmetic, rounded down.

    Null levels count as the empty name, null text as no words. Rows of one id have one place in an epoch and are
    taken together. A leaf without words has no budget and gives no rows. Input columns with the names added
    here are replaced. Empty input gives no rows."""
    names = [f"mix_{n}" for n in levels]
    own = [c for c in docs.columns if c not in {*names, "epoch", "tokens", "leaf_budget"}]
    named = docs.select(*own, *[F.coalesce(c.cast("string"), F.lit("")).alias(f"mix_{n}") for n, c in levels.items()])
    narrow = stored(named.select("doc_id", *names, words(F.col("text")).alias("tokens")))
    supply = stored(narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    total = int((supply.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    leaves = budgets(supply, names, weights, total, max_epochs)
    leaves = leaves.withColumnRenamed("tokens", "supply").withColumnRenamed("budget", "leaf_budget")
    leaves = leaves.withColumn("whole", F.expr("leaf_budget div supply")).withColumn("rest", F.expr("leaf_budget % supply"))
    leaves = stored(leaves)
    small = leaves.count() <= SMALL

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table) if small else table, names)

    # where the last epoch of each leaf stops: prefix sums over parts of the seeded order
    last = joined(narrow, leaves.where("rest > 0")).withColumn("at", seeded(F.col("whole"), F.col("doc_id"), seed))
    last = last.groupBy(*names, "rest", "at").agg(F.sum("tokens").alias("tokens"))
    last = last.withColumn("span", F.substring("at", 1, SPREAD))
    spans = last.groupBy(*names, "span").agg(F.sum("tokens").alias("span_tokens"))
    before = W.partitionBy(*names).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("span_before", F.coalesce(F.sum("span_tokens").over(before), F.lit(0)))
    inside = W.partitionBy(*names, "span").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(spans, [*names, "span"])
    cuts = last.where("span_before + inside < rest").groupBy(*names).agg(F.max("at").alias("cut"))
    plan = leaves.join(cuts, names, "left").select(*names, "leaf_budget", "whole", "cut")

    rows = joined(named, plan)
    taken = F.when(F.col("cut").isNotNull() & (seeded(F.col("whole"), F.col("doc_id"), seed) <= F.col("cut")), F.col("whole") + 1)
    rows = rows.withColumn("epochs", F.coalesce(taken, F.col("whole"))).where("epochs > 0")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - 1)")))
    return rows.select(*own, *names, "epoch", words(F.col("text")).alias("tokens"), "leaf_budget")


# The mix of the registered query and of the pipeline: four domains of five sources each.
DOMAINS = {"web": range(0, 5), "books": range(5, 10), "forum": range(10, 15), "notes": range(15, 20)}
WEIGHTS = {
    ("web",): 4,
    ("books",): 3,
    ("forum",): 2,
    ("notes",): 2,
    **{(d, lang): w for d in DOMAINS for lang, w in {"en": 5, "de": 2, "fr": 2, "es": 2}.items()},
}


def document_levels() -> dict[str, Column]:
    """Domain (from the source's group), language and source of ``documents``."""
    domain = F.lit("other")
    for name, numbers in DOMAINS.items():
        domain = F.when(F.col("source").isin([f"src{i}" for i in numbers]), name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The registered mix of ``documents``."""
    return mixed(docs, document_levels(), WEIGHTS)
