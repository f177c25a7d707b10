"""The registered queries."""

from pyspark.sql import DataFrame, SparkSession

from signalloom.catalog import (  # noqa: F401
    ingest,
    lookups,
    packets,
    people,
    radio,
    ran,
    report,
    sources,
    streams,
    transactions,
    voice,
)
from signalloom.catalog.base import CATALOG


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["a9_latency_statistics"].query(spark, sf_dir)


__all__ = ["CATALOG", "flagship"]
