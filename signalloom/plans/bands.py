"""Aggregates over a time band around each probe instant, without a join of pairs.

A band of length L that starts at ``t + lo`` covers the end of one cell of width L and the start
of the next one. So two running aggregates per cell, one from each side, answer every probe: the
work is linear in the rows, however many of them fall into one band. Both inputs are first
reduced to one row per key and microsecond, which bounds a window group by the cell width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def band_aggregate(
    probe: DataFrame,
    build: DataFrame,
    keys: list[str],
    lo_us: int,
    hi_us: int,
    aggs: dict[str, tuple[str, Column]],
    ts: str = "ts_us",
) -> DataFrame:
    """One row per distinct ``(keys, ts)`` of ``probe`` with ``aggs`` over the ``build`` rows of the
    same key whose ``ts`` lies in ``[ts + lo_us, ts + hi_us]``.

    ``aggs`` is ``{name: (kind, value)}`` with kind ``sum``, ``min`` or ``max``; ``ts`` is a bigint.
    """
    width = hi_us - lo_us
    cell = f"((_pos - pmod(_pos, {width}L)) div {width}L)"
    instants = (
        build.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.col(ts).alias("_pos"))
        .agg(*[_MERGE[kind](value).alias(name) for name, (kind, value) in aggs.items()])
        .withColumns({"_ask": F.lit(0), "_at": F.lit(None).cast("bigint")})
    )
    asked = probe.filter(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_at")).distinct()
    asks = asked.withColumn(
        "_a",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("_ask"), (F.col("_at") + lo_us).alias("_pos")),
                F.struct(F.lit(2).alias("_ask"), (F.col("_at") + hi_us).alias("_pos")),
            )
        ),
    ).select(*keys, "_at", "_a.*")
    rows = instants.unionByName(asks, allowMissingColumns=True).withColumn("_cell", F.expr(cell))
    group = Window.partitionBy(*keys, "_cell")
    upto = group.orderBy(F.col("_pos").asc())
    onward = group.orderBy(F.col("_pos").desc())
    answered = rows.select(
        *keys,
        "_at",
        "_ask",
        *[
            F.struct(
                _MERGE[kind](F.col(name)).over(upto).alias("upto"),
                _MERGE[kind](F.col(name)).over(onward).alias("onward"),
            ).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    ).filter("_ask > 0")
    return answered.groupBy(*keys, F.col("_at").alias(ts)).agg(
        *[
            _MERGE[kind](
                F.when(F.col("_ask") == 1, F.col(name)["onward"]).otherwise(F.col(name)["upto"])
            ).alias(name)
            for name, (kind, _) in aggs.items()
        ]
    )
