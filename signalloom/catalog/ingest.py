"""Failed files and columns of an ingest, configuration files and stored cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, register
from signalloom.catalog.packets import _FLOWS, _flows
from signalloom.operators import packets
from signalloom.session import new_folder
from signalloom.sources import dictionary, ingest_report, sinks


# Files of about 1,000 rows; of every three one is cut off in its first event, and one holds no list.
@register(
    "s6_failed_files",
    """SELECT DISTINCT CAST(row_no // 1000 AS BIGINT) AS part, 'json' AS kind,
      CASE row_no // 1000 % 3 WHEN 1 THEN 'no JSON' ELSE 'no list of objects' END AS reason
    FROM fx_radio_rows WHERE row_no // 1000 % 3 > 0""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    cells = F.struct(*[c for c in t.radio_rows.columns if c not in ("trace_id", "row_no")])
    events = t.radio_rows.groupBy(F.expr("row_no div 1000").alias("part")).agg(F.collect_list(cells).alias("events"))
    document = F.to_json(F.struct("events"))
    cut = F.expr("part % 3 = 1")
    value = F.when(cut, F.substring_index(document, "}", 1)).when(F.expr("part % 3 = 2"), F.to_json(F.struct(F.size("events").alias("n"))))
    events.select("part", F.coalesce(value, document).alias("value")).write.partitionBy("part").text(folder)
    return ingest_report.failed_texts(t.spark, folder, "json").select(
        F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"),
        "kind",
        F.split("reason", ":")[0].alias("reason"),
    )


@register(
    "s12_network_map",
    """SELECT concat('10.', 1 + s_suppkey // 65536, '.', s_suppkey // 256 % 256, '.', s_suppkey % 256) AS place, s_name AS name,
      NULL::BIGINT AS ord FROM supplier
    UNION ALL SELECT * FROM (VALUES ('10.0.0.0/30', 'Edge', 0::BIGINT), ('10.0.0.0/16', 'RAN', 1))""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    suppliers = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet").selectExpr(
        "concat('10.', 1 + s_suppkey div 65536, '.', s_suppkey div 256 % 256, '.', s_suppkey % 256) AS ip",
        "s_name AS name",
        "s_suppkey div 1000 AS part",
    )
    maps = suppliers.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("ip", "name"))).alias("mappings"))
    subnets = F.when(F.col("part") == 0, F.expr("map('10.0.0.0/30', 'Edge', '10.0.0.0/16', 'RAN')")).alias("subnets")
    maps.select("part", F.to_json(F.struct("mappings", subnets)).alias("value")).write.partitionBy("part").text(folder)
    exact, nets = dictionary.read_network_map(t.spark, folder)
    exact = exact.select(F.col("ip").alias("place"), "name", F.lit(None).cast("bigint").alias("ord"))
    return exact.unionByName(nets.select(F.col("cidr").alias("place"), "name", F.col("ord").cast("bigint").alias("ord")))


@register(
    "s13_vendor_codes",
    """SELECT DISTINCT concat('X.f', l_linenumber % 3) AS protocol, lower(concat('0x', to_hex(l_partkey % 200))) AS code,
      concat('Label ', l_partkey % 200) AS label FROM lineitem""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    lines = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").selectExpr(
        "l_linenumber % 3 AS family", "concat('0x', hex(l_partkey % 200)) AS code", "concat('Label ', l_partkey % 200) AS label"
    )
    codes = lines.distinct().groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("codes"))
    text = F.concat(F.lit('{"X.f'), "family", F.lit('": '), F.to_json(F.struct("codes")), F.lit("}"))
    codes.select("family", text.alias("value")).write.partitionBy("family").text(folder)
    return dictionary.read_vendor_codes(t.spark, folder)


@register(
    "s19_stored_signal_events",
    f"""WITH {_FLOWS} SELECT capture_id AS trace_id, start_us AS ts_us, protocol AS type, 0 AS table_no, packet_count FROM fx_flow""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    flows = _flows(t)
    sinks.write_capture(folder, packets.failure_totals(flows), flows)
    return sinks.load_signal_events(t.spark, folder, "flows").select("trace_id", "ts_us", "type", "table_no", "packet_count")
