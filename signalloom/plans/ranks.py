"""Rows at given ranks of a per-key total order, found by counting instead of by a global sort.

Ranks are located step by step: spans of 19 hours of the key, seconds of such a span, instants of a second, rows of an
instant. Each step counts with map-side combine and looks only into the parts the step before named, so no task sees a
whole key, and a window holds at most 65536 counts of a step however long the key lasts (spans: one per 19 hours).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.session import stored

_SPAN = 1 << 36  # microseconds per bucket of the first step, and of the second
_SECOND = 1 << 20


def rows_at_ranks(
    df: DataFrame,
    keys: list[str],
    ts: str,
    seq: str,
    ranks: Callable[[Column], tuple[Column, Column, Column]],
    span: int,
) -> DataFrame:
    """The rows of ``df`` at given 0-based ranks in ``(ts, seq)`` order, with ``rank`` and ``total``
    (the row count of the key). ``ranks(total)`` gives first, step and last rank as bigints.

    ``seq`` is unique within ``keys``; ``span`` is the width of a ``seq`` chunk.
    """
    placed = df.withColumns(
        {
            "_span": F.expr(f"`{ts}` div {_SPAN}L"),
            "_sec": F.expr(f"`{ts}` div {_SECOND}L"),
            "_part": F.expr(f"`{seq}` div {span}L"),
        }
    )

    def running(group: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*group).orderBy(*order)
        return F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    spans = placed.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    counted = spans.select(
        "*",
        (running(keys, ["_span"]) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    start, step, last = ranks(F.col("total"))
    first = (
        counted.withColumns({"_start": start, "_step": step, "_last": last})
        .withColumns(
            {
                "_k0": F.expr("greatest((_before - _start + _step - 1) div _step, 0L)"),
                "_k1": F.expr("(least(_before + _n - 1, _last) - _start) div _step"),
            }
        )
        .filter("_k1 >= _k0 and _last >= _start and _before + _n > _start")
        .withColumn(
            "_want",
            F.expr(
                "transform(sequence(_k0, _k1), k -> named_struct('rank', _start + k * _step,"
                " 'left', _start + k * _step - _before))"
            ),
        )
        .select(*keys, "_span", "total", "_want")
    )
    kept = (
        "transform(filter(_want, w -> w.left >= _before and w.left < _before + _n),"
        " w -> named_struct('rank', w.rank, 'left', w.left - _before))"
    )

    def within(found: DataFrame, outer: list[str], inner: list[str]) -> DataFrame:
        """The parts ``inner`` of the parts ``outer`` found before that hold wanted ranks. What is found is a table of at
        most one row per rank, written so that Spark knows how small it is and need not shuffle the rows to it."""
        found = stored(found)
        group = [*keys, *outer]
        counts = placed.join(found.select(*group), group, "left_semi").groupBy(*group, *inner).agg(F.count(F.lit(1)).alias("_n"))
        return (
            counts.withColumn("_before", running(group, inner) - F.col("_n"))
            .join(found, group)
            .withColumn("_want", F.expr(kept))
            .filter(F.size("_want") > 0)
            .select(*keys, *inner, "total", "_want")
        )

    seconds = within(first, ["_span"], ["_sec"])
    second = stored(within(seconds, ["_sec"], [ts, "_part"]))
    spot = [*keys, ts, "_part"]
    w = Window.partitionBy(*spot).orderBy(seq)
    return (
        placed.join(second.select(*spot), spot, "left_semi")
        .withColumn("_left", F.row_number().over(w) - 1)
        .join(second, spot)
        .withColumn("_hit", F.explode("_want"))
        .filter(F.col("_hit.left") == F.col("_left"))
        .withColumn("rank", F.col("_hit.rank"))
        .drop("_span", "_sec", "_part", "_left", "_want", "_hit")
    )
