"""Value dictionary of the dissector, vendor codes and the network map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom import dims


def parse_value_strings(lines: DataFrame) -> DataFrame:
    """Lines ``V<tab>field<tab>value<tab>label`` (column ``value``) as field, value, label, for the
    fields that hold causes. Values are decimal or hexadecimal; the last line of a value wins."""
    fields = [f for names in dims.CAUSE_FIELDS.values() for f in names]
    parts = F.split("value", "\t")
    number = F.get(parts, F.lit(2))
    value = F.when(
        number.startswith("0x"), F.conv(F.substring(number, 3, 32), 16, 10).try_cast("bigint")
    ).otherwise(F.trim(number).try_cast("bigint"))
    rows = lines.filter(F.col("value").startswith("V\t") & (F.size(parts) >= 4)).select(
        F.get(parts, F.lit(1)).alias("field"), value.alias("value"), F.get(parts, F.lit(3)).alias("label")
    )
    return rows.filter(F.col("field").isin(fields) & F.col("value").isNotNull())


def read_value_strings(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary dump in text files; the last line of a value wins."""
    rows = parse_value_strings(spark.read.text(path)).withColumn("line", F.monotonically_increasing_id())
    return rows.groupBy("field", "value").agg(F.max_by("label", "line").alias("label"))


def read_network_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Network map JSON as exact entries (ip, name) and subnets (cidr, name, ord in file order).

    The file is a small configuration: one JSON object per map.
    """
    schema = "mappings map<string,string>, subnets map<string,string>"
    config = spark.read.schema(schema).json(path, multiLine=True)
    exact = config.select(F.explode("mappings").alias("ip", "name"))
    subnets = config.select(F.posexplode("subnets").alias("ord", "cidr", "name"))
    return exact, subnets


def read_vendor_codes(spark: SparkSession, path: str) -> DataFrame:
    """Vendor reason-code JSON as (protocol, code, label), codes in lower case."""
    raw = spark.read.json(path, multiLine=True)
    families = [
        f.name
        for f in raw.schema.fields
        if f.dataType.typeName() == "struct" and "codes" in f.dataType.fieldNames()
    ]
    shape = "struct<codes:map<string,string>>"
    out = None
    for family in families:
        codes = F.from_json(F.to_json(F.col(f"`{family}`")), shape)["codes"]
        part = raw.select(F.lit(family).alias("protocol"), F.explode(codes).alias("code", "label"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no vendor codes in {path}")
    return out.withColumn("code", F.lower("code"))
