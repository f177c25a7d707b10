"""Registration of queries next to the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.session import cut_lineage
from signalloom.sources.sample_tables import TABLES, sample_table, table_sql


@dataclass(frozen=True)
class Item:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Item] = {}


class Inputs:
    """The derived tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return sample_table(self.spark, self.sf_dir, name)

    def stream(self, name: str) -> DataFrame:
        """The derived table as a stream."""
        return sample_table(self.spark, self.sf_dir, name, stream=True)

    def stored(self, name: str) -> DataFrame:
        """The derived table written once, for queries that read it several times."""
        return cut_lineage(sample_table(self.spark, self.sf_dir, name))


def with_tables(sql: str) -> str:
    """Prefix the SQL with the derived tables (``fx_name``) it mentions."""
    names = [n for n in TABLES if re.search(rf"\bfx_{n}\b", sql)]
    parts = [f"fx_{n} AS (\n{table_sql(n, 'duckdb')}\n)" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH " + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def register(name: str, sql: str | None = None):
    """Add a query (a function of :class:`Inputs`) to the catalog."""

    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        CATALOG[name] = Item(run, with_tables(sql) if sql else None)
        return fn

    return add


def joined(column: str, name: str | None = None, sep: str = "|") -> Column:
    """An array column as text."""
    text = F.array_join(F.col(column).cast("array<string>"), sep)
    return text.alias(name or column.split(".")[-1])


def r(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """A rounded double, so that both engines print the same digits."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits).alias(name or str(column))
