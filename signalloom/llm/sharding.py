"""Contiguous shards of near-equal byte size (dealt operator 5).

Rows are put in one global order by ranges; each range partition gives one total, the totals' prefix sums give
every row its global byte position, and the order is cut at equal targets. Only ids, sizes and digests move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.llm.store import stored


def with_prefix_sums(rows: DataFrame, order: list[str], size: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``before`` (sum of ``size`` over all earlier rows of the global ``order``), ``place`` (number
    of earlier rows) and ``part``. Running sums are taken inside range partitions; what one task sees of the rest
    is one total per partition. Equal keys are told apart by all of ``order``, so a hot value spans partitions."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum(size).alias("part_size"), F.count("*").alias("part_rows"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("part_place"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.withColumn("before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    ranged = ranged.withColumn("place", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
    ranged = ranged.join(totals, "part")
    ranged = ranged.withColumn("before", F.col("before") + F.col("part_before"))
    return ranged.withColumn("place", F.col("place") + F.col("part_place")).drop("part_before", "part_place")


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) in one of ``shards`` contiguous shards, near equal in bytes.

    Order: text digest, then doc_id, so equal texts are neighbours. A row's size is the UTF-8 bytes of its text
    plus 1. A shard ends where the global prefix sum passes its equal share. Equal texts stay in one shard when
    their sizes add up to no more than the largest single row, the error that any cut between rows can have;
    larger groups are cut between rows, so a hot text spoils no balance. Every shard's size is within twice the
    largest row of its share.

    Columns: doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 in the shard), grown_shard (null:
    a further shard moves all cuts). Null text is empty; null ids, repeated rows and extra columns are fine;
    empty input gives no rows, and fewer rows than shards leave shards empty."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, 32).alias("digest"),
    )
    rows = stored(with_prefix_sums(rows, ["digest", "doc_id"], "size"))
    # the ends of a group: aggregated map-side, so a hot group sends one row per task
    groups = rows.groupBy("digest").agg(F.min("before").alias("first"), F.sum("size").alias("group_size"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("digest", "first", "group_size")
    whole = rows.agg(F.max("size").alias("largest"), F.sum("size").alias("total")).first()  # two numbers
    rows = rows.join(groups, "digest", "left")
    # a row, or a small group of equal texts, belongs where its middle lies
    together = F.col("group_size") <= F.lit(whole.largest or 1)
    middle = F.when(together, 2 * F.col("first") + F.col("group_size")).otherwise(2 * F.col("before") + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * (whole.total or 1)))).cast("int")
    rows = rows.withColumn("shard", shard)
    starts = rows.groupBy("shard").agg(F.min("place").alias("start"))  # one row per shard
    rows = rows.join(F.broadcast(starts), "shard")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
