"""Neighbour lookups (lag / lead) that stay balanced when one key holds much of the table.

A window partitioned by the key alone sends a hot key to one task. Here the key is cut into
chunks of its order column, so that one window group holds at most ``span`` rows (the order
column is unique per key). The first and last row of each chunk are the only ones whose
neighbour lies outside; they go through a second window over the key that sees at most two rows
per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, tuple[str, Column]],
    span: int,
) -> DataFrame:
    """Add ``{name: (side, value)}`` columns, ``side`` being ``"lag"`` or ``"lead"``.

    ``order`` must be a bigint column that is unique within ``keys``.
    """
    pick = {"lag": F.lag, "lead": F.lead}
    chunked = df.withColumn("_chunk", F.expr(f"`{order}` div {span}L"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    marked = chunked.select(
        "*",
        *[pick[side](value).over(inside).alias(name) for name, (side, value) in columns.items()],
        F.lag(F.lit(1)).over(inside).isNull().alias("_head"),
        F.lead(F.lit(1)).over(inside).isNull().alias("_tail"),
    )
    across = Window.partitionBy(*keys).orderBy(order)
    edges = marked.filter("_head or _tail")
    for name, (side, value) in columns.items():
        flag = "_head" if side == "lag" else "_tail"
        edges = edges.withColumn(
            name, F.when(F.col(flag), pick[side](value).over(across)).otherwise(F.col(name))
        )
    drop = ("_chunk", "_head", "_tail")
    return marked.filter("not (_head or _tail)").unionByName(edges).drop(*drop)
