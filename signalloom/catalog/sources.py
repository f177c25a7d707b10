from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, register
from signalloom.catalog.packets import _FLOWS, _flows
from signalloom.catalog.radio import _EVENTS
from signalloom.functions import causes, radio
from signalloom.operators import packets
from signalloom.operators.radio import normalize_rows
from signalloom.session import new_folder
from signalloom.sources import dictionary, fields, radio_files, sinks


def _table(t: Inputs, name: str) -> DataFrame:
    return t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet")


@register(
    "p3_rtp_payload_types",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 128 AS payload_type FROM lineitem
    WHERE l_linenumber % 3 < 2 AND l_suppkey % 16 >= 10 AND l_partkey % 20000 >= 384 AND l_partkey % 20000 <= 16767""",
)
def _(t: Inputs) -> DataFrame:
    rows = _table(t, "lineitem").withColumn(
        "payload",
        F.expr(
            "unhex(concat(CASE l_linenumber % 3 WHEN 0 THEN '80' WHEN 1 THEN '90' ELSE '40' END,"
            " lpad(hex(l_partkey % 256), 2, '0'), repeat('00', cast(l_suppkey % 16 as int))))"
        ),
    )
    port = (F.col("l_partkey") % 20000 + 16000).cast("int")
    kind = packets.rtp_payload_type(F.col("payload"), port, F.lit(5000))
    out = rows.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("payload_type"))
    return out.filter("payload_type is not null").withColumn(
        "payload_type", F.col("payload_type").cast("bigint")
    )


@register(
    "p4_sip_failures",
    """SELECT sip_status, sip_reason, count(*) AS n FROM (SELECT CAST(100 + l_partkey % 600 AS INT) AS sip_status,
      concat('Reason ', l_linenumber) AS sip_reason FROM lineitem) WHERE sip_status >= 400 GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    rows = _table(t, "lineitem").selectExpr(
        "encode(concat('SIP/2.0 ', 100 + l_partkey % 600, ' Reason ', l_linenumber, '\\r\\nVia: x'),"
        " 'UTF-8') AS payload"
    )
    failed = packets.with_sip_failures(rows).filter("sip_status is not null")
    return failed.groupBy("sip_status", "sip_reason").agg(F.expr("count(1) AS n"))


@register(
    "p8_first_values",
    """SELECT capture_id, frame_number, coalesce(pfcp_cause, gtp_cause, ngap_cause) AS cause FROM fx_fields
    WHERE coalesce(pfcp_cause, gtp_cause, ngap_cause) IS NOT NULL""",
)
def _(t: Inputs) -> DataFrame:
    first = causes.first_value(F.lit(""), F.col("pfcp_cause"), F.col("gtp_cause"), F.col("ngap_cause"))
    out = t.fields.select("capture_id", "frame_number", first.alias("cause"))
    return out.filter("cause is not null")


@register(
    "s4_rows_of_pack",
    """SELECT capture_id, frame_number, frame_time_epoch, ip_src, ip_dst, s1ap_procedureCode, s1ap_MME_UE_S1AP_ID FROM fx_fields
    WHERE s1ap_procedureCode IS NOT NULL OR s1ap_MME_UE_S1AP_ID IS NOT NULL""",
)
def _(t: Inputs) -> DataFrame:
    return fields.rows_of_pack(t.fields, ["s1ap_procedureCode", "s1ap_MME_UE_S1AP_ID"])


@register(
    "s8_html_rows",
    """SELECT CAST(event_id AS STRING) AS trace_id, row_no, CASE row_no WHEN 0 THEN event_type ELSE 'ACK & more' END AS event
    FROM events, (VALUES (0), (1)) x(row_no)""",
)
def _(t: Inputs) -> DataFrame:
    pages = _table(t, "events").selectExpr(
        "event_id",
        "concat('<html><table><tr><td>small</td></tr></table><table><tr><th>Time</th><th>Event</th>"
        "</tr><tr><td>', user_id, '</td><td> ', event_type, '</td></tr><tr><td>ragged</td></tr>"
        "<tr><td>1</td><td><b>ACK</b> &amp; more</td></tr></table></html>') AS page",
    )
    rows = radio_files.html_rows(pages, "event_id", "page")
    event = F.regexp_replace(F.col("cells")["Event"], "^ACK& more$", "ACK & more").alias("event")
    return rows.select("trace_id", "row_no", event)


@register(
    "s2_field_export",
    """SELECT capture_id, frame_number, pfcp_msg_type, "sip_Call_ID" AS call_id, "sip_Reason" AS reason FROM fx_fields""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    export = t.fields.select(
        "capture_id",
        F.col("frame_number").alias("frame.number"),
        F.col("pfcp_msg_type").alias("pfcp.msg_type"),
        F.col("sip_Call_ID").alias("sip.Call-ID"),
        F.col("sip_Reason").alias("sip.Reason"),
    )
    # files of two headers, in another order of fields
    wide = export.filter("`frame.number` % 2 = 0").write.option("header", True).option("escape", '"')
    wide.partitionBy("capture_id").csv(folder)
    names = ["sip.Reason", "sip.Call-ID", "frame.number", "pfcp.msg_type", "capture_id"]
    turned = export.filter("`frame.number` % 2 = 1").select(*[F.col(f"`{c}`") for c in names], F.lit("x").alias("eth.type"))
    turned.write.mode("append").option("header", True).option("escape", '"').partitionBy("capture_id").csv(folder)
    return fields.read_fields(t.spark, folder).select(
        "capture_id",
        "frame_number",
        "pfcp_msg_type",
        F.col("sip_Call_ID").alias("call_id"),
        F.col("sip_Reason").alias("reason"),
    )


_NORMALISED = f"""WITH {_EVENTS}
    SELECT ts_us, event_type, cell_id, rsrp_v AS rsrp, count(*) AS n FROM fx_norm GROUP BY 1, 2, 3, 4"""


def _normalised(rows: DataFrame) -> DataFrame:
    events = normalize_rows(rows)
    return events.groupBy("ts_us", "event_type", "cell_id", "rsrp").agg(F.expr("count(1) AS n"))


# Files of two delimiters in one folder, with line breaks in quotes.
@register("s5_radio_csv", _NORMALISED)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    note = F.when(F.col("row_no") % 3 == 0, F.lit('first line\n\nsecond; "line", end'))
    rows = t.radio_rows.drop("trace_id").withColumn("note", note)
    for place, sep in enumerate(";,"):
        part = rows.filter(F.col("row_no") % 2 == place).drop("row_no")
        part = part.write.mode("append").option("header", True).option("sep", sep)
        part.option("escape", '"').csv(folder)
    return _normalised(radio_files.read_radio_csv(t.spark, folder))


# Documents of up to 1,000 events next to a longer list of another name.
@register("s6_radio_json", _NORMALISED)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    cells = F.struct(*[c for c in t.radio_rows.columns if c not in ("trace_id", "row_no")])
    part = F.expr("row_no div 1000").alias("part")
    events = t.radio_rows.groupBy(part).agg(F.collect_list(cells).alias("events"))
    other = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.struct(i.alias("alarm")))
    document = F.to_json(F.struct(other.alias("alarms"), F.struct("events").alias("log"), "events"))
    events.select("part", document.alias("value")).write.partitionBy("part").text(folder)
    return _normalised(radio_files.read_radio_json(t.spark, folder))


@register("s7_radio_xml", _NORMALISED)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    rows = t.radio_rows.drop("trace_id", "row_no")
    rows.write.format("xml").option("rootTag", "log").option("rowTag", "ev").save(folder)
    return _normalised(radio_files.read_radio_xml(t.spark, folder))


# Even pages hold a table, odd ones diagram lines under one clock.
@register(
    "s8_s9_mixed_pages",
    """SELECT page, event, clock, count(*) AS n FROM (
      SELECT event_id // 500 AS page, event_type AS event,
        CASE WHEN event_id // 500 % 2 = 0 THEN CAST(event_id AS STRING) ELSE concat('T', event_id // 500) END AS clock
      FROM events) GROUP BY 1, 2, 3""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    cells = "concat('<tr><td>', event_id, '</td><td>', event_type, '</td></tr>')"
    line = "concat('A->B: {\"type\":\"event\",\"message\":\"', event_type, '\",\"url\":\"\"}')"
    clock = "concat('N: {\"type\":\"datetime\",\"message\":\"T', page, '\"}')"
    head = "'<html><table><tr><th>Time</th><th>Event</th></tr>'"
    pages = _table(t, "events").withColumn("page", F.expr("event_id div 500")).groupBy("page").agg(
        F.expr(f"concat({head}, array_join(collect_list({cells}), ''), '</table></html>') AS rows"),
        F.expr(f"array_join(collect_list({line}), '\n') AS lines"),
    )
    text = F.expr(f"IF(page % 2 = 0, rows, concat({clock}, '\n', lines)) AS value")
    pages.select("page", text).write.partitionBy("page").text(folder)
    rows = radio_files.read_radio_html(t.spark, folder)
    page = F.regexp_extract("trace_id", "^page=([0-9]+)", 1).cast("bigint").alias("page")
    return rows.groupBy(page, F.coalesce("Event", "Message").alias("event"), F.col("Time").alias("clock")).agg(
        F.expr("count(1) AS n")
    )


# A folder of several formats, ingested: events and summary as written.
@register(
    "s11_s17_ingest_folder",
    f"""WITH {_EVENTS}
    SELECT event_type, count(*) AS n, CAST((SELECT count(*) FROM fx_norm) AS BIGINT) AS total FROM fx_norm GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    rows = t.radio_rows.drop("trace_id")
    rows.filter("row_no % 2 = 0").drop("row_no").write.option("header", True).csv(f"{folder}/in/a")
    rows.filter("row_no % 2 = 1").drop("row_no").write.format("xml").option("rootTag", "log").option(
        "rowTag", "ev"
    ).save(f"{folder}/in/b")
    events, summary = radio_files.ingest_radio(t.spark, f"{folder}/in", f"{folder}/out")
    total = summary.agg(F.sum("total_events").alias("total"))
    counts = events.groupBy("event_type").agg(F.expr("count(1) AS n"))
    return counts.join(total)


@register(
    "s15_stored_flows",
    f"""WITH {_FLOWS} SELECT capture_id, src_ip, dst_ip, protocol, packet_count, start_us FROM fx_flow""",
)
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark)
    flows = _flows(t)
    sinks.write_capture(folder, packets.failure_totals(flows), flows)
    return t.spark.read.parquet(f"{folder}/flows").select(
        "capture_id", "src_ip", "dst_ip", "protocol", "packet_count", "start_us"
    )


# Diagram lines of the events: every fifth line sets the clock, the others are events.
@register(
    "s9_w7_diagram_events",
    """SELECT trace_id, event_id, event_type AS message, node AS from_node, 'UE' AS to_node, clock FROM (
      SELECT *, last_value(CASE WHEN event_id % 5 = 0 THEN concat('T', event_id) END IGNORE NULLS) OVER (
          PARTITION BY trace_id ORDER BY event_id) AS clock
      FROM (SELECT *, concat('trace', user_id % 3) AS trace_id, concat('n', user_id % 4) AS node FROM events))
    WHERE event_id % 5 <> 0""",
)
def _(t: Inputs) -> DataFrame:
    lines = _table(t, "events").selectExpr(
        "concat('trace', user_id % 3) AS trace_id",
        "event_id div 700 * 65536 AS _block",
        "event_id AS _at",
        "IF(event_id % 5 = 0, concat('N: {\"type\":\"datetime\",\"message\":\"T', event_id, '\"}'),"
        " concat('n', user_id % 4, '->UE: {\"type\":\"event\",\"message\":\"', event_type,"
        " '\",\"url\":\"updateEventMessage(\\'%3CId%3E', event_id, '%3C%2FId%3E\\')\"}')) AS value",
    )
    out = radio_files.diagram_events(lines)
    return out.select(
        "trace_id",
        F.col("raw")["id"].cast("bigint").alias("event_id"),
        F.col("Message").alias("message"),
        "from_node",
        "to_node",
        F.col("Time").alias("clock"),
    )


@register(
    "s14_value_strings",
    """SELECT field, value, label, count(*) AS n FROM (
      SELECT CASE l_linenumber % 3 WHEN 0 THEN 'pfcp.cause' WHEN 1 THEN 'sip.Status-Code' END AS field,
        l_partkey % 100 AS value, concat('Label ', l_partkey % 100) AS label FROM lineitem)
    WHERE field IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t: Inputs) -> DataFrame:
    lines = _table(t, "lineitem").selectExpr(
        "concat('V\\t', CASE l_linenumber % 3 WHEN 0 THEN 'pfcp.cause' WHEN 1 THEN 'sip.Status-Code'"
        " ELSE 'other.field' END, '\\t', IF(l_suppkey % 2 = 0, concat('0x', hex(l_partkey % 100)),"
        " string(l_partkey % 100)), '\\tLabel ', l_partkey % 100) AS value"
    )
    parsed = dictionary.parse_value_strings(lines)
    return parsed.groupBy("field", "value", "label").agg(F.expr("count(1) AS n"))


@register(
    "f25_tag_values",
    """SELECT event_id, CAST(user_id AS STRING) AS ue, event_type AS kind FROM events""",
)
def _(t: Inputs) -> DataFrame:
    text = "concat('<UE>', user_id, '</UE> <internal>x</internal><kind> ', event_type, ' </kind>')"
    tags = radio.tag_values(F.expr(text))
    rows = _table(t, "events").select("event_id", tags.alias("m"))
    return rows.select("event_id", F.col("m")["ue"].alias("ue"), F.col("m")["kind"].alias("kind"))


@register(
    "f16_generations",
    """SELECT generation, rat, count(*) AS n FROM (SELECT CASE WHEN network_type = '4g' OR earfcn IS NOT NULL AND NOT coalesce(contains(detail, 'NR'), false)
        THEN '4G' WHEN contains(detail, 'NR') THEN '5G' ELSE 'UNKNOWN' END AS generation,
      CASE WHEN network_type = '4g' OR earfcn IS NOT NULL AND NOT coalesce(contains(detail, 'NR'), false) THEN 'EUTRAN'
        WHEN contains(detail, 'NR') THEN 'NR' ELSE 'UNKNOWN' END AS rat FROM fx_radio_rows) GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    found = radio.infer_generation(
        F.array("network_type", "cell_id"),
        F.col("event_name"),
        F.col("detail"),
        F.col("earfcn"),
        F.lit(None).cast("string"),
    )
    rows = t.radio_rows.select(found.alias("g")).select("g.*")
    return rows.groupBy("generation", "rat").agg(F.expr("count(1) AS n"))
