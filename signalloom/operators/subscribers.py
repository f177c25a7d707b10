"""Subscriber identities in transactions and the journey of each subscriber.

Identity columns, all optional: imsi, eps_imsi, supi, user_name, sip_from, sip_to, sip_identity,
imei and diameter_user (``imsi@realm``). A subscriber is named after its identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.causes import extract_msisdn, normalize_imsi
from signalloom.operators.packets import optional

IMSI_COLUMNS = ["imsi", "eps_imsi", "supi", "user_name"]
SIP_COLUMNS = ["sip_from", "sip_to", "sip_identity"]


def identities(transactions: DataFrame) -> DataFrame:
    """Distinct identities per capture: kind (imsi, msisdn, imei) and value."""

    def text(name: str) -> Column:
        return optional(transactions, name, "string")

    def item(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    user = F.split_part(text("diameter_user"), F.lit("@"), F.lit(1))
    items = [item("imsi", normalize_imsi(text(c))) for c in IMSI_COLUMNS]
    items += [
        item("msisdn", F.when(F.col("protocol") == "SIP", extract_msisdn(text(c))))
        for c in SIP_COLUMNS
    ]
    items += [
        item("imei", F.nullif(F.substring(text("imei"), 1, 15), F.lit(""))),
        item("imsi", normalize_imsi(user)),
    ]
    found = F.explode(F.array_compact(F.array(*items))).alias("_i")
    return transactions.select("capture_id", found).select("capture_id", "_i.*").distinct()


def assign_subscribers(transactions: DataFrame) -> DataFrame:
    """Add ``subscriber``: the first identity column whose value is a known IMSI or MSISDN, else
    UNIDENTIFIED.

    A value taken from the row itself by the same rule as :func:`identities` is known by definition;
    only rows whose first value is of another kind are looked up in the identity table.
    """

    names = [*IMSI_COLUMNS, "sip_from", "sip_to"]
    given = [(i, n) for i, n in enumerate(names) if n in transactions.columns]
    values = {}
    for i, name in given:
        values[f"_n{i}"] = normalize_imsi(F.col(name))
        values[f"_m{i}"] = extract_msisdn(F.col(name))
    items = ", ".join(
        f"IF(coalesce(_n{i}, _m{i}) IS NOT NULL, named_struct('pos', {i},"
        f" 'value', coalesce(_n{i}, _m{i}), 'sure', "
        + (f"_n{i} IS NOT NULL" if n in IMSI_COLUMNS else f"protocol = 'SIP' AND _n{i} IS NULL")
        + "), NULL)"
        for i, n in given
    )
    rows = transactions.withColumns(values)
    rows = rows.withColumns(
        {"_c": F.expr(f"array({items})"), "_first": F.expr(f"coalesce({items})")}
    ).drop(*values)
    settled = rows.filter("_first is null or _first.sure").withColumn(
        "subscriber", F.col("_first.value")
    )
    doubtful = rows.filter("not _first.sure")
    known = identities(transactions).filter("kind <> 'imei'").select("capture_id", "value")
    hits = (
        doubtful.select("capture_id", "frame_number", F.explode("_c").alias("_o"))
        .select("capture_id", "frame_number", "_o.pos", "_o.value")
        .join(known.distinct(), ["capture_id", "value"], "left_semi")
        .groupBy("capture_id", "frame_number")
        .agg(F.min_by("value", "pos").alias("subscriber"))
    )
    looked = doubtful.join(hits, ["capture_id", "frame_number"], "left")
    out = settled.unionByName(looked).drop("_c", "_first")
    return out.withColumn("subscriber", F.coalesce("subscriber", F.lit("UNIDENTIFIED")))


def journeys(assigned: DataFrame, causes: int = 5) -> DataFrame:
    """Per subscriber: transactions, protocols, failures and the first causes."""
    mine = assigned.filter("subscriber <> 'UNIDENTIFIED'")
    key = ["capture_id", "subscriber"]
    totals = mine.groupBy(*key).agg(
        F.expr("count(1) AS transaction_count"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.expr("count_if(status = 'failure') AS failures"),
    )
    order = Window.partitionBy(*key).orderBy("frame_number")
    first = (
        mine.filter("cause is not null")
        .select(*key, "frame_number", F.coalesce("cause_label", "cause").alias("_c"))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= causes)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("_r", "_c"))).alias("_f"))
        .selectExpr(*key, "_f._c AS top_causes")
    )
    out = totals.join(first, key, "left")
    return out.withColumn("top_causes", F.expr("coalesce(top_causes, array())"))


def journey_summary(assigned: DataFrame) -> DataFrame:
    """Per capture: number of subscribers and of transactions without one."""
    cells = assigned.groupBy("capture_id", "subscriber").agg(F.expr("count(1) AS n"))
    return cells.groupBy("capture_id").agg(
        F.expr("count_if(subscriber <> 'UNIDENTIFIED') AS subscriber_count"),
        F.expr(
            "coalesce(sum(n) FILTER (WHERE subscriber = 'UNIDENTIFIED'), 0) AS unidentified_count"
        ),
    )


def without_subscriber(assigned: DataFrame) -> DataFrame:
    """Transactions that belong to no known subscriber."""
    return assigned.filter("subscriber = 'UNIDENTIFIED'")
