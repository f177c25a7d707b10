"""Roles and names of network nodes, and the message ladder between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom import dims
from signalloom.config import CHUNK_FRAMES
from signalloom.operators.packets import optional
from signalloom.plans.ranks import rows_at_ranks
from signalloom.session import stored

NODE = ["capture_id", "ip"]


def _voted_role():
    """Role of the sender by protocol, message type and Diameter application, from one table."""
    table = {f"NGAP/Proc-{c}": role for c, role in dims.NGAP_ROLES.items()}
    table.update({f"S1AP/Proc-{c}": role for c, role in dims.S1AP_ROLES.items()})
    table.update({f"PFCP/PFCP-Msg-{c}": role for c, role in dims.PFCP_ROLES.items()})
    table.update({f"GTPv2-C/GTP-Msg-{c}": role for c, role in dims.GTPV2_ROLES.items()})
    named = {}
    for code, command in dims.DIAMETER_COMMANDS.items():
        for app, interface in dims.ROLE_APPS.items():
            if command in dims.DIAMETER_ROLES.get(interface, {}):
                named[f"{app}/Cmd-{code}"] = dims.DIAMETER_ROLES[interface][command]
        for interface in dims.DIAMETER_ROLE_ORDER:
            if command in dims.DIAMETER_ROLES[interface]:
                table.setdefault(f"Diameter/Cmd-{code}", dims.DIAMETER_ROLES[interface][command])
    message = F.col("message_type")
    sip = (
        F.when(
            message.contains("REGISTER"),
            F.when(message.contains("Response"), "S-CSCF").otherwise("UE"),
        )
        .when(message == "INVITE", "Caller")
        .when(message.contains("100") | message.contains("Trying"), "P-CSCF")
        .when(message.contains("180") | message.contains("Ring"), "Callee")
    )
    by_application = dims.lookup(named, F.concat_ws("/", "_app", "message_type"))
    return F.coalesce(
        F.when(F.col("protocol") == "Diameter", by_application),
        dims.lookup(table, F.concat_ws("/", "protocol", "message_type")),
        F.when(F.col("protocol") == "SIP", sip),
    )


def role_votes(transactions: DataFrame) -> DataFrame:
    """Votes per address and role, from the senders of role-specific messages.

    Rows are counted per sender and message type first, so roles are looked up once per kind.
    """
    kinds = (
        transactions.filter("src is not null and dst is not null")
        .withColumn("_app", optional(transactions, "diameter_app", "string"))
        .groupBy("capture_id", F.col("src").alias("ip"), "protocol", "message_type", "_app")
        .agg(F.expr("count(1) AS n"), F.min("frame_number").alias("first"))
    )
    voted = kinds.withColumn("role", _voted_role()).filter("role is not null")
    return voted.groupBy(*NODE, "role").agg(
        F.sum("n").alias("votes"), F.min("first").alias("first_frame")
    )


def classify_nodes(votes: DataFrame) -> DataFrame:
    """Role with most votes per address; the one seen first among equals."""
    best = F.min_by("role", F.struct((-F.col("votes")).alias("v"), "first_frame"))
    return votes.groupBy(*NODE).agg(best.alias("role"))


def _ends(transactions: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("src").alias("ip"), F.col("dst").alias("peer"), F.lit(True).alias("sent")),
        F.struct(F.col("dst").alias("ip"), F.col("src").alias("peer"), F.lit(False).alias("sent")),
    )
    rows = transactions.filter("src is not null and dst is not null")
    return rows.select(
        "capture_id",
        "frame_number",
        "protocol",
        F.concat_ws("_", "protocol", "message_type").alias("message"),
        F.explode(ends).alias("_e"),
    ).select("capture_id", "frame_number", "protocol", "message", "_e.*")


def node_peers(transactions: DataFrame) -> DataFrame:
    """Distinct peers per address."""
    return _ends(transactions).select(*NODE, "peer").distinct()


def node_evidence(transactions: DataFrame, first: int = 10) -> DataFrame:
    """Per address: protocols, messages sent and received, number of peers, the first messages.

    Rows are reduced per peer and protocol before the address totals are formed.
    """
    ends = _ends(transactions)
    cells = ends.groupBy(*NODE, "peer", "protocol").agg(
        F.expr("count_if(sent) AS sent"), F.expr("count_if(NOT sent) AS received")
    )
    totals = cells.groupBy(*NODE).agg(
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.sum("sent").alias("messages_sent"),
        F.sum("received").alias("messages_received"),
        F.count_distinct("peer").alias("peers"),
    )
    order = Window.partitionBy(*NODE, "sent").orderBy("frame_number")
    head = (
        ends.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= first)
        .groupBy(*NODE)
        .agg(
            F.expr("array_sort(collect_list(struct(_r, message)) FILTER (WHERE sent)) AS _s"),
            F.expr("array_sort(collect_list(struct(_r, message)) FILTER (WHERE NOT sent)) AS _g"),
        )
        .selectExpr(*NODE, "_s.message AS first_sent", "_g.message AS first_received")
    )
    return totals.join(head, NODE, "left")


def unresolved_nodes(transactions: DataFrame, roles: DataFrame) -> DataFrame:
    """Addresses without a role."""
    return _ends(transactions).select(*NODE).distinct().join(roles, NODE, "left_anti")


def heuristic_roles(packets: DataFrame) -> DataFrame:
    """Role per sender from packets: GTP create-session messages overwrite (the last one counts), all
    other hints count only as the first one."""

    def given(name: str, kind: str) -> str:
        return name if name in packets.columns else f"CAST(NULL AS {kind})"

    gtp = given("gtp_type", "int")
    rows = packets.filter("src_ip is not null").selectExpr(
        "capture_id",
        "src_ip AS ip",
        "frame_number",
        f"CASE {gtp} WHEN 32 THEN 'MME' WHEN 33 THEN 'SGW/PGW' END AS _over",
        f"CASE WHEN {given('sip_status', 'int')} BETWEEN 400 AND 699 THEN 'SIP_Server'"
        f" WHEN {given('sip_method', 'string')} IN ('REGISTER', 'INVITE') THEN 'SIP_Endpoint'"
        f" WHEN {gtp} IN (1, 20) THEN 'GTP_Node'"
        f" WHEN {given('pfcp_type', 'string')} IS NOT NULL THEN 'PFCP_Entity'"
        f" WHEN {given('protocol', 'string')} = 'DNS' OR src_port = 53 OR dst_port = 53 THEN"
        " IF(src_port = 53, 'DNS_Server', 'DNS_Client') END AS _hint",
    )
    return (
        rows.filter("_over is not null or _hint is not null")
        .groupBy(*NODE)
        .agg(
            F.expr(
                "coalesce(max_by(_over, frame_number) FILTER (WHERE _over IS NOT NULL),"
                " min_by(_hint, frame_number) FILTER (WHERE _hint IS NOT NULL)) AS role"
            )
        )
    )


def ip_number(ip):
    """IPv4 address as a number, NULL for anything else."""
    parts = F.split(ip, r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*octet) <= 255)
    value = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    return F.when(valid, value)


def resolve_addresses(addresses: DataFrame, exact: DataFrame, subnets: DataFrame) -> DataFrame:
    """Name of each distinct ``ip``: exact entry, else first matching subnet in map order with the last
    octet, else the address itself.

    ``subnets`` carries cidr, name and ord. Each prefix length in use is one equi-join key, so subnets
    are found by hash lookups. At most 33 lengths exist; only they are read on the driver.
    """
    distinct = addresses.select("ip").distinct()
    length = F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    size = F.pow(F.lit(2), 32 - F.col("_len")).cast("bigint")
    network = ip_number(F.split_part("cidr", F.lit("/"), F.lit(1)))
    nets = subnets.withColumn("_len", length).withColumns({"_num": network, "_size": size})
    nets = nets.withColumn("_net", F.expr("_num div _size"))
    lengths = sorted(r["_len"] for r in nets.select("_len").distinct().collect())
    if lengths:
        tries = (
            distinct.withColumn("_num", ip_number(F.col("ip")))
            .filter("_num is not null")
            .withColumn("_len", F.expr(f"explode(array({dims.sql_list(lengths)}))"))
            .withColumn("_size", size)
            .withColumn("_net", F.expr("_num div _size"))
            .select("ip", "_len", "_net")
        )
        found = (
            tries.join(nets.select("_len", "_net", "name", "ord"), ["_len", "_net"])
            .groupBy("ip")
            .agg(F.min_by("name", "ord").alias("_subnet"))
        )
        named = distinct.join(found, "ip", "left")
    else:
        named = distinct.withColumn("_subnet", F.lit(None).cast("string"))
    known = exact.select("ip", F.col("name").alias("_exact"))
    out = named.join(known, "ip", "left")
    octet = F.element_at(F.split("ip", r"\."), -1)
    return out.select(
        "ip",
        F.coalesce("_exact", F.concat("_subnet", F.lit("_"), octet), "ip").alias("name"),
    )


def with_node_names(
    messages: DataFrame,
    roles: DataFrame,
    resolved: DataFrame,
    heuristics: DataFrame,
) -> DataFrame:
    """Add src_name and dst_name: classified role, else configured name, else heuristic role, else the
    address."""
    out = messages
    for side in ("src", "dst"):
        ip = f"{side}_ip"
        out = out.join(
            roles.select("capture_id", F.col("ip").alias(ip), F.col("role").alias("_role")),
            ["capture_id", ip],
            "left",
        )
        out = out.join(
            resolved.select(F.col("ip").alias(ip), F.col("name").alias("_name")), ip, "left"
        )
        out = out.join(
            heuristics.select("capture_id", F.col("ip").alias(ip), F.col("role").alias("_guess")),
            ["capture_id", ip],
            "left",
        )
        out = out.withColumn(
            f"{side}_name",
            F.expr(
                f"coalesce(_role, nullif(nullif(_name, {ip}), 'Unknown'), _guess, {ip})"
            ),
        ).drop("_role", "_name", "_guess")
    return out


def sample_messages(
    packets: DataFrame, max_messages: int = 100, span: int = CHUNK_FRAMES
) -> DataFrame:
    """Evenly spaced packets of each capture in time order: every ``n // max``-th, ``max`` in all."""

    def ranks(total):
        step = F.greatest(F.floor(total / max_messages), F.lit(1)).cast("bigint")
        return F.lit(0).cast("bigint"), step, F.least(total - 1, step * (max_messages - 1))

    addressed = packets.filter("src_ip is not null and dst_ip is not null")
    return rows_at_ranks(addressed, ["capture_id"], "ts_us", "frame_number", ranks, span)


def message_sequence(
    packets: DataFrame,
    roles: DataFrame,
    exact: DataFrame,
    subnets: DataFrame,
    max_messages: int = 100,
    span: int = CHUNK_FRAMES,
) -> DataFrame:
    """The message ladder: sampled packets with node names and a protocol text, in rank order. The sample is written once,
    so that packets are not searched again for the addresses in it."""

    def given(name: str, kind: str) -> str:
        return name if name in packets.columns else f"CAST(NULL AS {kind})"

    gtp, teid = given("gtp_type", "int"), given("gtp_teid", "bigint")
    method, status = given("sip_method", "string"), given("sip_status", "int")
    pfcp, app = given("pfcp_type", "string"), given("diameter_app_id", "bigint")
    sampled = stored(sample_messages(packets, max_messages, span)).withColumn(
        "info",
        F.expr(
            f"CASE WHEN {pfcp} IS NOT NULL THEN concat('PFCP ', {pfcp})"
            f" WHEN {method} IS NOT NULL THEN concat('SIP ', {method})"
            f" WHEN {status} IS NOT NULL THEN concat('SIP ', {status})"
            f" WHEN {app} IS NOT NULL THEN 'Diameter Unknown'"
            f" WHEN {gtp} IS NOT NULL THEN concat('GTP ', {gtp},"
            f" IF({teid} <> 0, concat(' TEID:', {teid}), '')) ELSE '' END"
        ),
    )
    ends = sampled.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    names = resolve_addresses(ends, exact, subnets)
    named = with_node_names(sampled, roles, names, heuristic_roles(packets))
    return named.select(
        "capture_id",
        "rank",
        "ts_us",
        "frame_number",
        "src_ip",
        "dst_ip",
        F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        F.coalesce("protocol", F.lit("Unknown")).alias("protocol"),
        F.coalesce("transport", F.lit("Unknown")).alias("transport"),
        "length",
        "info",
        "src_name",
        "dst_name",
    )


def ladder_protocols(messages: DataFrame) -> DataFrame:
    """Distinct first protocols of the ladder."""
    first = F.split_part("protocol", F.lit("/"), F.lit(1)).alias("protocol")
    return messages.filter("protocol is not null").select("capture_id", first).distinct()


def first_endpoints(messages: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` addresses of each capture in order of appearance, with a short alias."""
    ends = messages.select(
        "capture_id",
        F.explode(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), F.lit(0).alias("side")),
                F.struct(F.col("dst_ip").alias("ip"), F.lit(1).alias("side")),
            )
        ).alias("e"),
        "ts_us",
        "frame_number",
    )
    first = (
        ends.filter("e.ip is not null")
        .groupBy("capture_id", F.col("e.ip").alias("ip"))
        .agg(F.min(F.struct("ts_us", "frame_number", "e.side")).alias("_at"))
    )
    order = Window.partitionBy("capture_id").orderBy("_at")
    ranked = first.withColumn("idx", F.row_number().over(order)).filter(F.col("idx") <= n)
    octets = F.split("ip", r"\.")
    alias = F.when(F.size(octets) == 4, F.element_at(octets, -1)).otherwise(F.col("idx"))
    return ranked.select(
        "capture_id", "idx", "ip", F.concat(F.lit("Node_"), alias).alias("alias")
    )


def ladder_messages(
    messages: DataFrame, protocol: str | None = None, endpoints: int = 8, limit: int = 50
) -> DataFrame:
    """Messages between the first endpoints of a capture that contain a protocol, the first ``limit``."""
    known = first_endpoints(messages, endpoints).select("capture_id", "ip")
    out = messages if protocol is None else messages.filter(F.col("protocol").contains(protocol))
    for side in ("src_ip", "dst_ip"):
        out = out.join(known.withColumnRenamed("ip", side), ["capture_id", side], "left_semi")
    order = Window.partitionBy("capture_id").orderBy("ts_us", "frame_number")
    return out.withColumn("idx", F.row_number().over(order)).filter(F.col("idx") <= limit)
