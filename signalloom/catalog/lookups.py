from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom import dims
from signalloom.catalog.base import Inputs, register
from signalloom.functions import causes


def _table(name: str, table: dict) -> str:
    rows = ", ".join(f"({k}, '{v}')" for k, v in table.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) x(code, label))"


# Every code 0..99 (and Diameter 2001..5450) occurs as a cause of some part, supplier or order.
_CODES = """
fx_code AS (
  SELECT protocol, code, count(*) AS n FROM (
    SELECT 'PFCP' AS protocol, CAST(l_partkey % 80 AS STRING) AS code FROM lineitem
    UNION ALL SELECT 'GTPv2-C', CAST(l_partkey % 101 AS STRING) FROM lineitem
    UNION ALL SELECT 'NGAP', CAST(l_suppkey % 121 AS STRING) FROM lineitem
    UNION ALL SELECT 'SIP', CAST(100 + l_orderkey % 505 AS STRING) FROM lineitem
    UNION ALL SELECT 'Diameter', CAST(2000 + l_orderkey % 3451 AS STRING) FROM lineitem
    UNION ALL SELECT 'NAS-EMM', CAST(l_partkey % 41 AS STRING) FROM lineitem
    UNION ALL SELECT 'NAS-ESM', CAST(l_partkey % 67 AS STRING) FROM lineitem
    UNION ALL SELECT 'Other', CAST(l_linenumber AS STRING) FROM lineitem
    UNION ALL SELECT 'PFCP', l_returnflag FROM lineitem) GROUP BY 1, 2
)"""
_LABELS = ", ".join(
    [
        _table("pfcp", dims.PFCP_CAUSES),
        _table("gtp", dims.GTPV2_CAUSES),
        _table("ngap", dims.NGAP_CAUSES),
        _table("dbase", dims.DIAMETER_BASE),
        _table("d3gpp", dims.DIAMETER_3GPP),
        _table("sip", dims.SIP_STATUS),
        _table("emm", dims.NAS_EMM_CAUSES),
        _table("esm", dims.NAS_ESM_CAUSES),
    ]
)
_FOUND = """
fx_found AS (
  SELECT c.*, TRY_CAST(c.code AS BIGINT) AS v, coalesce(p.label, g.label, n.label, s.label, e.label, m.label) AS plain,
    b.label AS base, d.label AS extra
  FROM fx_code c LEFT JOIN pfcp p ON c.protocol = 'PFCP' AND p.code = TRY_CAST(c.code AS INT)
  LEFT JOIN gtp g ON c.protocol = 'GTPv2-C' AND g.code = TRY_CAST(c.code AS INT)
  LEFT JOIN ngap n ON c.protocol = 'NGAP' AND n.code = TRY_CAST(c.code AS INT)
  LEFT JOIN sip s ON c.protocol = 'SIP' AND s.code = TRY_CAST(c.code AS INT)
  LEFT JOIN emm e ON c.protocol = 'NAS-EMM' AND e.code = TRY_CAST(c.code AS INT)
  LEFT JOIN esm m ON c.protocol = 'NAS-ESM' AND m.code = TRY_CAST(c.code AS INT)
  LEFT JOIN dbase b ON c.protocol = 'Diameter' AND b.code = TRY_CAST(c.code AS INT)
  LEFT JOIN d3gpp d ON c.protocol = 'Diameter' AND d.code = TRY_CAST(c.code AS INT)
)"""


_CODE_SOURCES = [
    ("PFCP", "l_partkey % 80"),
    ("GTPv2-C", "l_partkey % 101"),
    ("NGAP", "l_suppkey % 121"),
    ("SIP", "100 + l_orderkey % 505"),
    ("Diameter", "2000 + l_orderkey % 3451"),
    ("NAS-EMM", "l_partkey % 41"),
    ("NAS-ESM", "l_partkey % 67"),
    ("Other", "l_linenumber"),
    ("PFCP", "l_returnflag"),
]


def _codes(t: Inputs) -> DataFrame:
    rows = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    pairs = rows.select(
        F.explode(
            F.expr(
                "array("
                + ", ".join(
                    f"named_struct('protocol', '{p}', 'code', string({code}))"
                    for p, code in _CODE_SOURCES
                )
                + ")"
            )
        ).alias("c")
    )
    return pairs.groupBy("c.protocol", "c.code").agg(F.expr("count(1) AS n"))


@register(
    "p13_cause_labels",
    f"""WITH {_CODES}, {_LABELS}, {_FOUND}
    SELECT protocol, code, n, CASE WHEN v IS NULL THEN code ELSE coalesce(plain, base, extra, CASE protocol
      WHEN 'SIP' THEN concat('Status ', v) WHEN 'Diameter' THEN concat('Diameter Code ', v) WHEN 'NAS-EMM' THEN concat('EMM Cause ', v)
      WHEN 'NAS-ESM' THEN concat('ESM Cause ', v) WHEN 'Other' THEN code ELSE concat('Unknown Cause ', v) END) END AS label
    FROM fx_found""",
)
def _(t: Inputs) -> DataFrame:
    label = causes.cause_label(F.col("protocol"), F.col("code")).alias("label")
    return _codes(t).select("protocol", "code", "n", label)


@register(
    "p14_mapped_causes",
    f"""WITH {_CODES}, {_LABELS}, {_FOUND}
    SELECT protocol, code, n, CASE WHEN v IS NULL THEN concat('INVALID(', code, ')')
        ELSE coalesce(plain, extra, base, concat('UNMAPPED(', v, ')')) END AS label,
      CASE WHEN v IS NOT NULL AND coalesce(plain, extra, base) IS NOT NULL THEN 'static_3gpp' ELSE 'unmapped' END AS source,
      v IS NOT NULL AND coalesce(plain, extra, base) IS NOT NULL AS is_mapped FROM fx_found""",
)
def _(t: Inputs) -> DataFrame:
    mapped = causes.mapped_cause(F.col("protocol"), F.col("code"))
    out = _codes(t).withColumn("m", mapped)
    return out.select("protocol", "code", "n", "m.label", "m.source", "m.is_mapped")


@register(
    "p15_mapped_transactions",
    f"""WITH {_LABELS}
    SELECT t.capture_id, t.frame_number, coalesce(p.label, g.label, concat('UNMAPPED(', t.cause, ')')) AS label,
      CASE WHEN p.label IS NOT NULL OR g.label IS NOT NULL THEN 'static_3gpp' ELSE 'unmapped' END AS source
    FROM fx_transactions t LEFT JOIN pfcp p ON t.protocol = 'PFCP' AND p.code = CAST(t.cause AS INT)
    LEFT JOIN gtp g ON t.protocol = 'GTPv2-C' AND g.code = CAST(t.cause AS INT) WHERE t.cause IS NOT NULL""",
)
def _(t: Inputs) -> DataFrame:
    rows = t.transactions.filter("cause is not null").withColumnRenamed("cause", "cause_code")
    out = causes.map_causes(rows, {"cause_code": "cause_mapped"})
    return out.select(
        "capture_id", "frame_number", "cause_mapped.label", "cause_mapped.source"
    )


@register(
    "p17_p18_diameter_names",
    """SELECT diameter_applicationId AS app, diameter_cmd_code AS cmd, CASE diameter_applicationId WHEN '16777251' THEN 'S6a' ELSE 'Gx' END AS name,
      CASE diameter_applicationId WHEN '16777251' THEN 'MME↔HSS' ELSE 'PGW↔PCRF' END AS interface,
      CASE diameter_cmd_code WHEN '316' THEN 'ULR' WHEN '317' THEN 'CLR' WHEN '272' THEN 'CCR' ELSE '999' END AS command, count(*) AS n
    FROM fx_fields WHERE diameter_cmd_code IS NOT NULL GROUP BY ALL""",
)
def _(t: Inputs) -> DataFrame:
    info = causes.diameter_interface(F.col("diameter_applicationId"))
    rows = t.fields.filter("diameter_cmd_code is not null").select(
        F.col("diameter_applicationId").alias("app"),
        F.col("diameter_cmd_code").alias("cmd"),
        info["name"].alias("name"),
        info["interface"].alias("interface"),
        causes.diameter_command(F.col("diameter_cmd_code")).alias("command"),
    )
    return rows.groupBy(*rows.columns).agg(F.expr("count(1) AS n"))


@register(
    "f4_f5_subscriber_values",
    """SELECT capture_id, frame_number, CASE WHEN length(regexp_replace(imsi, '[^0-9]', '', 'g')) IN (14, 15)
        THEN regexp_replace(imsi, '[^0-9]', '', 'g') END AS imsi,
      nullif(regexp_extract(sip_from, '[+]?[0-9]{10,15}'), '') AS caller, nullif(regexp_extract(sip_to, 'tel:([+0-9]+)', 1), '') AS callee
    FROM fx_identified""",
)
def _(t: Inputs) -> DataFrame:
    return t.identified.select(
        "capture_id",
        "frame_number",
        causes.normalize_imsi(F.col("imsi")).alias("imsi"),
        causes.extract_msisdn(F.col("sip_from")).alias("caller"),
        causes.extract_msisdn(F.col("sip_to")).alias("callee"),
    )


@register(
    "f23_thresholds",
    """SELECT protocol, CASE protocol WHEN 'SIP' THEN 32000.0 WHEN 'Diameter' THEN 4000.0 ELSE 5000.0 END AS timeout_ms,
      CASE protocol WHEN 'SIP' THEN 200.0 WHEN 'S1AP' THEN 500.0 ELSE 1000.0 END AS warning_ms, count(*) AS n
    FROM fx_identified GROUP BY 1, 2, 3""",
)
def _(t: Inputs) -> DataFrame:
    from signalloom.operators.transactions import threshold

    rows = t.identified.groupBy("protocol").agg(F.expr("count(1) AS n"))
    return rows.select(
        "protocol",
        threshold(F.col("protocol"), "response_timeout_ms").alias("timeout_ms"),
        threshold(F.col("protocol"), "latency_warning_ms").alias("warning_ms"),
        "n",
    )
