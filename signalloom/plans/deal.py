"""Rows dealt by key into as many parts as their number asks for.

Adaptive execution sizes parts by compressed bytes. Rows that compress well and then pass several sorts and windows in
one task take many times that in memory, so for them the number of rows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def deal(rows: DataFrame, keys: list[Column], total: int, each: int) -> DataFrame:
    """``rows`` dealt by ``keys``: if ``total`` is more than ``each``, into ``total / each`` parts, or into the session's
    shuffle partitions if these are more."""
    if total <= each:
        return rows.repartition(*keys)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, -(-total // each)), *keys)
