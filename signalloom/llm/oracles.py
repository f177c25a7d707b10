"""DuckDB SQL of those dealt operators that SQL can express on whole tables."""

from __future__ import annotations

from signalloom.llm import linkgraph, mixing

def near_duplicates_sql(size: int, num: int, den: int) -> str:
    """Components of documents by shared shingles of ``size`` words."""
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) END AS s
  FROM worded
), members AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE {den} * k >= {num} * (len(x.s) + len(y.s) - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT e.b, reached.r FROM reached JOIN both_ways e ON e.a = reached.doc_id
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY 1) c ON c.doc_id = sets.doc_id
"""


def mixing_sql(seed: int = 5, max_epochs: int = 3) -> str:
    """The registered mix."""
    domains = " ".join(
        f"WHEN source IN ({', '.join(repr(f'src{i}') for i in numbers)}) THEN '{name}'" for name, numbers in mixing.DOMAINS.items()
    )
    levels = ["mix_domain", "mix_lang", "mix_source"]
    parts = [
        f"""named AS MATERIALIZED (
  SELECT doc_id, CASE {domains} ELSE 'other' END AS mix_domain, coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents)""",
        f"supply AS MATERIALIZED (SELECT {', '.join(levels)}, CAST(sum(tokens) AS BIGINT) AS tokens FROM named GROUP BY ALL HAVING sum(tokens) > 0)",
        "above0 AS (SELECT CAST(sum(tokens) AS BIGINT) AS parent_budget FROM supply)",
    ]
    for depth in range(1, 4):
        path, parent = levels[:depth], levels[: depth - 1]
        key = " || '/' || ".join(path)
        weights = " ".join(f"WHEN {key} = '{'/'.join(n)}' THEN {w}" for n, w in sorted(mixing.WEIGHTS.items()) if len(n) == depth)
        weight = f"CASE {weights} ELSE 1 END" if weights else "1"
        family = f"PARTITION BY {', '.join(parent)}" if parent else ""
        using = f"JOIN above{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN above0"
        order = f"{family} ORDER BY most / weight, {path[-1]}"
        parts += [
            f"nodes{depth} AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM (SELECT {', '.join(path)}, "
            f"CAST(sum(tokens) * {max_epochs} AS BIGINT) AS most FROM supply GROUP BY ALL) {using})",
            f"filling{depth} AS (SELECT *, parent_budget - coalesce(sum(most) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, "
            f"sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavier FROM nodes{depth})",
            f"filled{depth} AS (SELECT *, most * heavier <= weight * room AS filled FROM filling{depth})",
            f"opened{depth} AS (SELECT *, first_value(CASE WHEN NOT filled THEN room END IGNORE NULLS) OVER whole AS first_room, "
            f"first_value(CASE WHEN NOT filled THEN heavier END IGNORE NULLS) OVER whole AS first_heavier FROM filled{depth} "
            f"WINDOW whole AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
            f"above{depth} AS MATERIALIZED (SELECT {', '.join(path)}, CAST(CASE WHEN filled THEN most ELSE weight * first_room // first_heavier END AS BIGINT) "
            f"AS parent_budget FROM opened{depth})",
        ]
    leaf = ", ".join(levels)
    at = f"md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    parts += [
        f"leaves AS MATERIALIZED (SELECT {leaf}, parent_budget AS leaf_budget, parent_budget // tokens AS whole, parent_budget % tokens AS rest "
        f"FROM supply JOIN above3 USING ({leaf}))",
        f"placed AS (SELECT {leaf}, rest, {at} AS spot, sum(tokens) AS tokens FROM named JOIN leaves USING ({leaf}) WHERE rest > 0 GROUP BY ALL)",
        f"summed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {leaf} ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)",
        f"cuts AS (SELECT {leaf}, max(spot) AS cut FROM summed WHERE before < rest GROUP BY ALL)",
        f"taken AS (SELECT doc_id, {leaf}, tokens, leaf_budget, whole + CASE WHEN cut IS NOT NULL AND {at} <= cut THEN 1 ELSE 0 END AS epochs "
        f"FROM named JOIN leaves USING ({leaf}) LEFT JOIN cuts USING ({leaf}))",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {leaf}, unnest(range(0, epochs)) AS epoch, tokens, leaf_budget FROM taken WHERE epochs > 0"


def link_graph_sql(rounds: int = 20, damping: float = 0.85, threshold: float = 0.5) -> str:
    """The registered verdicts; the flow runs all rounds."""
    upper, lower = linkgraph.UPPER, linkgraph.LOWER
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in linkgraph.RULES)
    links = linkgraph.LINKS.replace("'", "''")
    parts = [
        f"""split_urls AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))""",
        f"rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules})",
        """fits AS (SELECT r, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS fit
  FROM split_urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)""",
        "judged AS MATERIALIZED (SELECT split_urls.*, rule, fit FROM split_urls LEFT JOIN fits USING (r))",
        f"""links AS MATERIALIZED (SELECT host AS source, target, count(*) AS n FROM (
  SELECT host, translate(regexp_extract(url, '//([^/?#]*)', 1), '{upper}', '{lower}') AS target
  FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{links}', 1)) AS url FROM judged WHERE host <> ''))
  WHERE target <> '' AND target <> host GROUP BY 1, 2)""",
        """hosts AS MATERIALIZED (SELECT host, coalesce(mass, 0.0::DOUBLE) AS mass, coalesce(good, 0.0::DOUBLE) AS good, coalesce(bad, 0.0::DOUBLE) AS bad
  FROM (SELECT host, count(*)::DOUBLE AS mass, count(*) FILTER (fit = 'allow')::DOUBLE AS good, count(*) FILTER (fit = 'block')::DOUBLE AS bad
    FROM judged WHERE host <> '' GROUP BY 1)
  FULL JOIN (SELECT DISTINCT target AS host FROM links) USING (host))""",
    ]
    for name, value, source, target in (("f", "good", "source", "target"), ("b", "bad", "target", "source")):
        parts += [
            f"{name}_edges AS MATERIALIZED (SELECT {source} AS s, {target} AS t, n / sum(n) OVER (PARTITION BY {source}) AS share FROM links)",
            f"{name}0 AS (SELECT host, mass, {value} AS part FROM hosts)",
        ]
        for i in range(1, rounds + 1):
            sums = [
                f"{1 - damping!r}::DOUBLE * h.{seed} + {damping!r}::DOUBLE * (coalesce(i.{col}, 0) + CASE WHEN h.host IN (SELECT s FROM {name}_edges) THEN 0 ELSE p.{col} END) AS {col}"
                for seed, col in (("mass", "mass"), (value, "part"))
            ]
            parts.append(
                f"{name}{i} AS MATERIALIZED (SELECT h.host, {', '.join(sums)} FROM hosts h JOIN {name}{i - 1} p USING (host) LEFT JOIN "
                f"(SELECT t AS host, sum(mass * share) AS mass, sum(part * share) AS part FROM {name}_edges JOIN {name}{i - 1} q ON q.host = s GROUP BY 1) i USING (host))"
            )
    part = "CASE WHEN mass > 0 THEN part / mass ELSE 0 END"
    parts.append(f"trusted AS (SELECT host, {part} AS trust FROM f{rounds})")
    parts.append(f"distrusted AS (SELECT host, {part} AS distrust FROM b{rounds})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, "
        f"coalesce(fit, CASE WHEN coalesce(distrust - trust, 0) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict, "
        "round(trust, 9) AS trust, round(distrust, 9) AS distrust "
        "FROM judged LEFT JOIN trusted USING (host) LEFT JOIN distrusted USING (host)"
    )


def clusters_sql(k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """k-means on integer vectors of 64 components, round by round."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        f"""vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY spot) - 1 AS INTEGER) AS cluster, v AS c FROM "
        f"(SELECT sha256('{seed}:' || vec_id) AS spot, v FROM vectors ORDER BY spot LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, cluster, {distance} AS distance FROM vectors, c{i})")
        parts.append(f"n{i} AS MATERIALIZED (SELECT * FROM a{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts += [
                f"s{i} AS (SELECT cluster, p, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS p FROM n{i}) GROUP BY ALL)",
                f"m{i} AS (SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{i} GROUP BY cluster)",
                f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))",
            ]
    parts.append(f"sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM n{rounds} GROUP BY cluster)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster, distance::BIGINT AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM sums) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM n{rounds} JOIN sums USING (cluster) JOIN c{rounds} USING (cluster)"
    )
