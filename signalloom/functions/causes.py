"""Cause labels, vendor reasons and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import dims


def first_value(*columns: Column) -> Column:
    """First column that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def as_int(value: Column) -> Column:
    """Integer in a text, NULL when it is none."""
    return F.trim(value.cast("string")).try_cast("bigint")


def _by_protocol(protocol: Column, code: Column, tables: list[tuple[list[str], Column]]) -> Column:
    out = None
    for names, label in tables:
        hit = protocol.isin(names)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def cause_label(protocol: Column, code: Column) -> Column:
    """Label of a cause with a protocol-specific text for unknown codes; Diameter base codes first."""
    n = as_int(code)

    def labelled(table: dict, prefix: str) -> Column:
        return F.coalesce(dims.lookup(table, n), F.concat(F.lit(prefix), n.cast("string")))

    diameter = F.coalesce(
        dims.lookup(dims.DIAMETER_BASE, n),
        dims.lookup(dims.DIAMETER_3GPP, n),
        F.concat(F.lit("Diameter Code "), n.cast("string")),
    )
    known = _by_protocol(
        protocol,
        n,
        [
            (["PFCP"], labelled(dims.PFCP_CAUSES, "Unknown Cause ")),
            (["GTP", "GTPv2", "GTPv2-C"], labelled(dims.GTPV2_CAUSES, "Unknown Cause ")),
            (["NGAP", "S1AP"], labelled(dims.NGAP_CAUSES, "Unknown Cause ")),
            (["SIP"], labelled(dims.SIP_STATUS, "Status ")),
            (["Diameter"], diameter),
            (["NAS-EMM", "EMM"], labelled(dims.NAS_EMM_CAUSES, "EMM Cause ")),
            (["NAS-ESM", "ESM"], labelled(dims.NAS_ESM_CAUSES, "ESM Cause ")),
        ],
    )
    return F.when(n.isNull(), code.cast("string")).otherwise(
        F.coalesce(known, n.cast("string"))
    )


def static_label(protocol: Column, code: Column) -> Column:
    """Label in the standard tables alone; for Diameter the 3GPP codes win over the base codes."""
    n = as_int(code)
    return _by_protocol(
        protocol,
        n,
        [
            (["PFCP"], dims.lookup(dims.PFCP_CAUSES, n)),
            (["GTPv2-C"], dims.lookup(dims.GTPV2_CAUSES, n)),
            (["NGAP", "S1AP"], dims.lookup(dims.NGAP_CAUSES, n)),
            (["Diameter"], dims.lookup({**dims.DIAMETER_BASE, **dims.DIAMETER_3GPP}, n)),
            (["NAS-EMM"], dims.lookup(dims.NAS_EMM_CAUSES, n)),
            (["NAS-ESM"], dims.lookup(dims.NAS_ESM_CAUSES, n)),
            (["SIP"], dims.lookup(dims.SIP_STATUS, n)),
        ],
    )


def mapped_cause(protocol: Column, code: Column, dictionary_label: Column | None = None) -> Column:
    """Struct (code, label, source, is_mapped, protocol): dissector dictionary, then standard
    tables, then ``UNMAPPED(n)``; ``INVALID(x)`` for a code that is no integer."""
    n = as_int(code)
    listed = F.lit(None).cast("string") if dictionary_label is None else dictionary_label
    listed = F.nullif(listed, F.lit(""))
    fixed = static_label(protocol, code)
    missing = F.concat(F.lit("UNMAPPED("), n.cast("string"), F.lit(")"))
    invalid = F.concat(F.lit("INVALID("), F.coalesce(code.cast("string"), F.lit("")), F.lit(")"))
    return F.struct(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("code"),
        F.when(n.isNull(), invalid).otherwise(F.coalesce(listed, fixed, missing)).alias("label"),
        F.when(n.isNull(), "unmapped")
        .when(listed.isNotNull(), "wireshark")
        .when(fixed.isNotNull(), "static_3gpp")
        .otherwise("unmapped")
        .alias("source"),
        (n.isNotNull() & F.coalesce(listed, fixed).isNotNull()).alias("is_mapped"),
        protocol.alias("protocol"),
    )


def map_causes(
    df: DataFrame,
    columns: dict[str, str],
    protocol: str = "protocol",
    dictionary: DataFrame | None = None,
    hints: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``{code column: output column}`` structs; rows with a NULL code get a NULL struct.

    ``dictionary`` is the table of :func:`signalloom.sources.dictionary.read_value_strings`. A code
    column with a hint (a column holding a dictionary field name) uses that field alone when the
    dictionary knows it, else the fields of the protocol in their order.
    """
    out = df
    hints = hints or {}
    if dictionary is not None:
        order = F.create_map(
            *[
                x
                for p, names in dims.CAUSE_FIELDS.items()
                for i, n in enumerate(names)
                for x in (F.lit(n), F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")))
            ]
        )
        by_protocol = (
            dictionary.filter(F.col("label") != "")
            .withColumn("_o", F.try_element_at(order, F.col("field")))
            .filter("_o is not null")
            .groupBy(F.col("_o.p").alias("_p"), F.col("value").alias("_v"))
            .agg(F.min_by("label", F.col("_o.i")).alias("_by_protocol"))
        )
        by_field = dictionary.groupBy(F.col("field").alias("_f"), F.col("value").alias("_v")).agg(
            F.max("label").alias("_by_field")
        )
        fields = dictionary.select(F.col("field").alias("_f"), F.lit(True).alias("_known"))
        fields = fields.distinct()
    for code, name in columns.items():
        label = None
        if dictionary is not None:
            out = out.withColumn("_n", as_int(F.col(code)))
            out = out.join(
                by_protocol,
                (F.col(protocol) == F.col("_p")) & (F.col("_n") == F.col("_v")),
                "left",
            ).drop("_p", "_v")
            label = F.col("_by_protocol")
            if code in hints:
                hint = F.col(hints[code])
                out = out.join(
                    by_field, (hint == F.col("_f")) & (F.col("_n") == F.col("_v")), "left"
                ).drop("_f", "_v")
                out = out.join(fields, hint == F.col("_f"), "left").drop("_f")
                label = F.when(F.col("_known"), F.col("_by_field")).otherwise(label)
        mapping = mapped_cause(F.col(protocol), F.col(code), label)
        out = out.withColumn(name, F.when(F.col(code).isNotNull(), mapping))
        out = out.drop("_n", "_by_protocol", "_by_field", "_known")
    return out


def parse_reason(header: Column) -> Column:
    """SIP Reason header as struct (protocol, cause, text, vendor, add_info, pattern, is_vendor)."""
    text = F.regexp_replace(header, r"^\s+|\s+$", "")
    text = F.nullif(text, F.lit(""))
    vendor_form = text.startswith("X.")

    def group(pattern: str) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))

    lead = F.when(vendor_form, F.split_part(text, F.lit(";"), F.lit(1))).otherwise(
        group(r"^([A-Za-z0-9._-]+)")
    )
    cause = F.when(vendor_form, group(r"reasoncode=([0-9a-fA-Fx]+)")).otherwise(
        group(r"cause=(\d+)")
    )
    words = F.when(~vendor_form, group(r'text="?([^"]*)"?'))
    add_info = F.when(vendor_form, group(r"add-info=([0-9a-fA-F.]+)"))
    pattern = dims.first_match(F.lower(words), [(p.lower(), p) for p in dims.HUAWEI_PATTERNS])
    nokia = F.when(lead == "X.int", "Nokia").otherwise("Unknown")
    return F.struct(
        lead.alias("protocol"),
        cause.alias("cause"),
        words.alias("text"),
        F.when(add_info.isNotNull(), nokia)
        .when(pattern.isNotNull(), "Huawei")
        .alias("vendor"),
        add_info.alias("add_info"),
        pattern.alias("pattern"),
        F.coalesce(vendor_form | pattern.isNotNull(), F.lit(False)).alias("is_vendor"),
    )


def nokia_label(code: Column) -> Column:
    """Label of a vendor reason code given as hex with or without ``0x``."""
    low = F.lower(code)
    return dims.lookup(
        dims.NOKIA_CODES, F.when(low.startswith("0x"), low).otherwise(F.concat(F.lit("0x"), low))
    )


def huawei_info(text: Column) -> Column:
    """Struct (pattern, component, meaning) of the first pattern in ``text``, else NULL."""
    low = F.lower(text)

    def part(i: int | None) -> Column:
        items = dims.HUAWEI_PATTERNS.items()
        return dims.first_match(low, [(p.lower(), p if i is None else v[i]) for p, v in items])

    return F.when(
        part(None).isNotNull(),
        F.struct(part(None).alias("pattern"), part(0).alias("component"), part(1).alias("meaning")),
    )


def vendor_label(reason: Column) -> Column:
    """Readable label of a parsed vendor reason; NULL for a standard one."""
    info = huawei_info(reason["text"])
    huawei = F.concat(F.lit("Huawei "), info["component"], F.lit(": "), info["meaning"])
    unnamed = F.concat(F.lit("Nokia "), reason["protocol"], F.lit(" code "), reason["cause"])
    nokia = F.when(
        reason["protocol"].startswith("X."), F.coalesce(nokia_label(reason["cause"]), unnamed)
    )
    return F.when(reason["is_vendor"], F.coalesce(huawei, nokia))


def reason_display(reason: Column) -> Column:
    """One-line text of a parsed reason."""

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    head, cause, text = reason["protocol"], reason["cause"], reason["text"]
    unmapped = F.concat(
        shown(head),
        F.lit(" "),
        shown(cause),
        F.lit(": unlisted code of the vendor"),
    )
    return (
        F.when(vendor_label(reason).isNotNull(), vendor_label(reason))
        .when(reason["is_vendor"], unmapped)
        .when(text != "", F.concat(shown(head), F.lit(" "), shown(cause), F.lit(": "), text))
        .when(cause.isNotNull(), F.concat(shown(head), F.lit(" cause="), cause))
        .otherwise("Unknown reason")
    )


def diameter_interface(app_id: Column) -> Column:
    """Struct (name, interface, description) of a Diameter application id."""

    def part(i: int) -> Column:
        return dims.lookup({k: v[i] for k, v in dims.DIAMETER_APPS.items()}, as_int(app_id))

    other = F.concat(F.lit("App-ID "), app_id.cast("string"))
    return F.struct(
        F.coalesce(part(0), F.lit("Unknown")).alias("name"),
        F.coalesce(part(1), other).alias("interface"),
        F.coalesce(part(2), F.lit("")).alias("description"),
    )


def role_interface(app_id: Column) -> Column:
    """Interface name of an application id as used for node roles."""
    return F.coalesce(dims.lookup(dims.ROLE_APPS, as_int(app_id)), F.lit("Unknown"))


def diameter_command(code: Column) -> Column:
    """Abbreviation of a Diameter command code, else the code itself."""
    return F.coalesce(dims.lookup(dims.DIAMETER_COMMANDS, as_int(code)), code.cast("string"))


def normalize_imsi(value: Column) -> Column:
    """Digits of an IMSI when there are 14 or 15 of them."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits).between(14, 15), digits)


def extract_msisdn(value: Column) -> Column:
    """Number after ``tel:``, else the first run of 10 to 15 digits."""
    tel = F.when(value.contains("tel:"), F.regexp_extract(value, r"tel:([+\d]+)", 1))
    run = F.regexp_extract(value, r"(\+?\d{10,15})", 1)
    return F.coalesce(F.nullif(tel, F.lit("")), F.nullif(run, F.lit("")))


def confidence_level(percent: Column) -> Column:
    """HIGH from 80, MEDIUM from 50, else LOW."""
    return F.when(percent >= 80, "HIGH").when(percent >= 50, "MEDIUM").otherwise("LOW")
