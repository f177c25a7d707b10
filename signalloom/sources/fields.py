"""Dissector field exports (CSV) as the all-string table the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.schemas import column_name
from signalloom.sources.delimited import POSITION, read_delimited, spellings


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports with a header per file, one folder per capture (``capture_id=...``) or one file per capture.

    Each file's own header decides where its columns are; files of other fields share the table by name. Empty values
    become NULL and rows without any value are dropped. Column names get underscores for dots and hyphens.
    """
    raw = read_delimited(spark, path, [","])
    capture = "capture_id" if "capture_id" in raw.columns else "trace_id"
    names = [c for c in raw.columns if c not in {"trace_id", "capture_id", *POSITION}]
    cells = spellings([column_name(c) for c in names], lambda n: F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in names if column_name(c) == n]))
    rows = raw.select(F.col(capture).alias("capture_id"), *cells)
    return rows.dropna("all", subset=[c for c in rows.columns if c != "capture_id"])


def rows_of_pack(fields: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that carry at least one of the given columns, with the core columns and these."""
    core = ["capture_id", "frame_number", "frame_time_epoch", "ip_src", "ip_dst"]
    known = [c for c in columns if c in fields.columns]
    return fields.select(*[c for c in core if c in fields.columns], *known).dropna(
        "all", subset=known
    )
