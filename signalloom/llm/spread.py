"""Joins whose keys may be hot on the row side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``table``, which has a key at most once; no task gets many rows of one key.

    A key is hot if it has more than an eighth of a shuffle partition's even share of ``rows``, so at most eight keys a
    partition are hot: these are broadcast with their number of salts, ``rows`` take a salt by chance of their content
    and ``table`` repeats a hot key once per salt. ``rows`` are read twice and should be stored."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, rows.count() // (8 * parts))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    hot = F.broadcast(hot.where("salts > 1"))
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")
    left = rows.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    right = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return left.join(right.drop("salts"), [key, "salt"], how).drop("salt")
