"""SDP bodies, preconditions and SIP header fields as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINES = r"\r\n|\r|\n"
#: Fixed values of RFC 3264 and of the RTP profiles that are read.
DIRECTIONS = ["sendrecv", "sendonly", "recvonly", "inactive"]
PROFILES = ["RTP/AVP", "RTP/SAVP", "UDP/TLS/RTP/SAVP"]
_ADDRESS_LETTERS = "0123456789abcdefABCDEF.:"

MEDIA_TYPE = (
    "array<struct<type:string,ip:string,port:int,rtcp_port:int,codec:string,"
    "payload_types:array<string>,direction:string,phase:string>>"
)


def _words(line: Column) -> Column:
    """The words of a line; the first one starts with the type of the line, as in ``m=audio``."""
    return F.split(F.trim(line), " +")


def _digits(word: Column) -> Column:
    return (word != "") & (F.translate(word, "0123456789", "") == "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once per row: a lambda's variable holds it wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fields(words: Column) -> Column:
    """What the words of a line say: ``ip`` of a connection line, ``direction`` and ``mapped`` (payload type and codec) of attributes,
    ``media`` (kind, port, payload types) of an audio or video line; NULL where it says nothing of the kind."""
    first, second, third = (F.get(words, F.lit(i)) for i in range(3))
    ip = F.substring_index(third, "/", 1)
    known = (first == "c=IN") & second.isin("IP4", "IP6") & (ip != "") & (F.translate(ip, _ADDRESS_LETTERS, "") == "")
    attribute = F.when(first.startswith("a="), F.substr(first, F.lit(3)))
    pt = F.when(attribute.startswith("rtpmap:"), F.substr(attribute, F.lit(8)))
    kind = F.when(first.isin("m=audio", "m=video"), F.substr(first, F.lit(3)))
    media = kind.isNotNull() & _digits(second) & third.isin(PROFILES) & (F.size(words) > 3)
    types = F.filter(F.slice(words, 4, F.greatest(F.size(words), F.lit(1))), _digits)
    return F.struct(
        F.when(known, ip).alias("ip"),
        F.when(attribute.isin(DIRECTIONS), attribute).alias("direction"),
        F.when(_digits(pt) & second.isNotNull(), F.struct(pt.alias("pt"), F.substring_index(second, "/", 1).alias("codec"))).alias("mapped"),
        F.when(media, F.struct(kind.alias("kind"), second.try_cast("int").alias("port"), types.alias("types"))).alias("media"),
    )


def parse_sdp(body: Column, phase: Column) -> Column:
    """Audio and video lines of an SDP body, each with the last address and direction seen before it
    and the codec of its first payload type. One pass over the lines of the row, no shuffle."""
    fields = F.transform(F.transform(F.split(body, _LINES), _words), _fields)
    found = _once(fields, lambda f: _once(_codecs(f), lambda codecs: _media(f, codecs, phase)))
    return F.coalesce(found, F.array().cast(MEDIA_TYPE))


def _codecs(fields: Column) -> Column:
    return F.transform(F.filter(fields, lambda f: f["mapped"].isNotNull()), lambda f: f["mapped"])


def _media(fields: Column, codecs: Column, phase: Column) -> Column:
    def codec_of(pt: Column) -> Column:
        listed = F.try_element_at(F.filter(codecs, lambda c: c["pt"] == pt), F.lit(-1))["codec"]
        return F.coalesce(listed, F.concat(F.lit("PT-"), pt))

    def entry(media: Column, ip: Column, direction: Column) -> Column:
        first = F.coalesce(F.get(media["types"], F.lit(0)), F.when(media["kind"] == "audio", "0").otherwise("96"))
        return F.struct(
            media["kind"].alias("type"),
            ip.alias("ip"),
            media["port"].alias("port"),
            (media["port"] + 1).alias("rtcp_port"),
            codec_of(first).alias("codec"),
            media["types"].alias("payload_types"),
            direction.alias("direction"),
            phase.alias("phase"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("ip"),
        F.lit("sendrecv").alias("direction"),
        F.array().cast(MEDIA_TYPE).alias("found"),
    )

    def step(state: Column, field: Column) -> Column:
        ip, direction = (F.coalesce(field[name], state[name]) for name in ("ip", "direction"))
        found = F.when(
            field["media"].isNotNull(), F.array_append(state["found"], entry(field["media"], ip, direction))
        ).otherwise(state["found"])
        return F.struct(ip.alias("ip"), direction.alias("direction"), found.alias("found"))

    useful = F.filter(fields, lambda f: F.coalesce(f["ip"], f["direction"], f["media"]["kind"]).isNotNull())
    return F.aggregate(useful, start, step, lambda state: state["found"])


def sdp_phase(msg_type: Column, code: Column) -> Column:
    """offer for INVITE and 183, answer for 200, else unknown."""
    return (
        F.when((msg_type == "INVITE") | msg_type.contains("183") | (code == "183"), "offer")
        .when(code.contains("200"), "answer")
        .otherwise("unknown")
    )


def parse_preconditions(body: Column) -> Column:
    """RFC 3312 lines as struct (desired, current, confirmed)."""
    lines = F.transform(F.split(F.lower(body), _LINES), _words)

    def rows(attribute: str, names: list[str]) -> Column:
        hits = F.filter(lines, lambda w: (F.get(w, F.lit(0)) == f"a={attribute}:qos") & (F.size(w) > len(names)))
        return F.transform(hits, lambda w: F.struct(*[F.get(w, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]))

    return F.struct(
        rows("des", ["strength", "status_type", "direction"]).alias("desired"),
        rows("curr", ["type", "status"]).alias("current"),
        rows("conf", ["type", "status"]).alias("confirmed"),
    )


def has_preconditions(parsed: Column) -> Column:
    """TRUE when any precondition line was found."""
    sizes = [F.size(parsed[n]) for n in ("desired", "current", "confirmed")]
    return F.coalesce((sizes[0] > 0) | (sizes[1] > 0) | (sizes[2] > 0), F.lit(False))


def mandatory_met(parsed: Column) -> Column:
    """TRUE when each mandatory line is met by a current or confirmed status."""
    seen = F.transform(F.concat(parsed["current"], parsed["confirmed"]), lambda s: s["status"])
    return F.forall(
        parsed["desired"],
        lambda d: (d["strength"] != "mandatory")
        | F.exists(seen, lambda s: (s == d["direction"]) | (s == "sendrecv")),
    )


def session_expires(header: Column) -> Column:
    """Struct (seconds, refresher) of a header like ``1800;refresher=uac``."""
    parts = F.transform(F.split(header, ";"), lambda p: F.trim(p))
    seconds = F.get(parts, F.lit(0)).try_cast("int")
    named = F.get(F.filter(parts, lambda p: p.startswith("refresher=")), F.lit(0))
    return F.when(
        seconds.isNotNull(),
        F.struct(seconds.alias("seconds"), F.substr(named, F.lit(len("refresher=") + 1)).alias("refresher")),
    )
