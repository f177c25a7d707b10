"""Registered queries of the dealt operators, next to their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.packing import pack_documents
    from signalloom.llm.tokens import public_path

    return pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.token_counts import count_tokens
    from signalloom.llm.tokens import public_path

    return count_tokens(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@query("op4_wavelet_files")
def wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.tokens import public_path
    from signalloom.llm.wavelet import encoded_documents

    return encoded_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query("op8_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


@query("op6_link_graph", oracles.link_graph_sql())
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.linkgraph import RULES, url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


@query("op10_mixing", oracles.mixing_sql())
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "mix_domain", "mix_lang", "mix_source", "epoch", "tokens", "leaf_budget"
    )


@query("op3_winnowing")
def winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.winnowing import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op7_parity_sketch_join", oracles.near_duplicates_sql(4, 85, 100))
def parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.paritysketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


@query(
    "op9_cover_tree_search",
    """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * d.vec[i])) AS BIGINT) AS score
  FROM whole q JOIN whole d ON d.vec_id <> q.vec_id AND len(d.vec) = len(q.vec)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
""",
)
def cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.covertree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@query("op11_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.alignment import alignment_statistics
    from signalloom.llm.tokens import public_path

    return alignment_statistics(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


@query("op12_bit_planes", oracles.clusters_sql())
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.bitplanes import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_trie_join")
def trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.llm.bittrie import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))
