"""What an ingest could not use: files without rows and columns without a field."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.radio import map_columns
from signalloom.sources import radio_files


def reason_without_rows(kind: str, text: str) -> str | None:
    """Why a JSON, XML or HTML text has no rows; None if it has some."""
    if not text.strip():
        return "empty"
    if kind == "json":
        try:
            json.loads(text)
        except json.JSONDecodeError as problem:
            return f"no JSON: {problem.msg}, line {problem.lineno}"
        return None if radio_files.json_rows(text) else "no list of objects"
    if kind == "xml":
        try:
            expat.ParserCreate().Parse(text.encode(), True)
        except expat.ExpatError as problem:
            return f"no XML: {problem}"
        return None if radio_files.row_element(text) else "no repeated element"
    drawn = any("{" in line and line.rstrip().endswith("}") for line in text.splitlines())
    return None if drawn or radio_files.page_rows(text) else "no table, script or diagram"


def failed_texts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, kind, reason of the files at ``path`` that have no rows when read as ``kind`` (json, xml or html). Each file
    is judged by one task, as it is read."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reasons = [reason_without_rows(kind, text) for text in batch["page"]]
            yield pd.DataFrame({"file": batch["_file"], "kind": kind, "reason": reasons}).dropna(subset="reason")

    texts = radio_files.whole_files(spark, path).select("_file", "page")
    return texts.mapInPandas(judge, "file string, kind string, reason string")


def failed_files(spark: SparkSession, path: str) -> DataFrame:
    """The same for all JSON, XML and HTML files at ``path`` (one, or all below a folder), each by its ending. Files of no
    bytes are not told."""
    out = None
    for extension, kind in radio_files.FORMATS.items():
        if kind != "csv":
            any_case = "".join(f"[{c}{c.upper()}]" for c in extension)
            found = failed_texts(radio_files.Below(spark, any_case), path, kind)
            out = found if out is None else out.unionByName(found)
    return out


def column_report(rows: DataFrame, strict: bool = False) -> DataFrame:
    """column, field (NULL for a column that is kept as it is) and filled, the number of rows with a text in it, of
    the columns of raw rows and of the keys in their map ``raw``. Aggregates, reduced before their shuffle."""
    cells = [c for c, kind in rows.dtypes if c not in ("trace_id", "row_no") and not kind.startswith("map")]
    fields = map_columns(cells, strict)

    def filled(name: str):
        ref = F.col("`" + name.replace("`", "``") + "`").cast("string")
        return F.count_if(F.trim(ref) != "")

    totals = rows.agg(*[filled(c).alias(f"c{i}") for i, c in enumerate(cells)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(fields.get(c)).cast("string").alias("field"), F.col(f"c{i}").alias("filled"))
        for i, c in enumerate(cells)
    ]
    out = totals.select(F.inline(F.array(*entries)))
    if dict(rows.dtypes).get("raw", "").startswith("map"):
        kept = rows.select(F.explode("raw").alias("column", "text")).where("trim(text) <> ''").groupBy("column").agg(F.count("*").alias("filled"))
        out = out.unionByName(kept.select("column", F.lit(None).cast("string").alias("field"), "filled"))
    return out


def ingest_with_report(spark: SparkSession, path: str, out: str, zone: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ingest ``path`` (:func:`radio_files.ingest_radio`); beside events and summary, write the failed files and the columns
    below ``out``. Returns events, failed files and columns as written."""
    events, _ = radio_files.ingest_radio(spark, path, out, zone)
    failed_files(spark, path).write.mode("overwrite").parquet(f"{out}/radio_failed")
    column_report(radio_files.read_radio(spark, path)).write.mode("overwrite").parquet(f"{out}/radio_columns")
    return events, spark.read.parquet(f"{out}/radio_failed"), spark.read.parquet(f"{out}/radio_columns")
