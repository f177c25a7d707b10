"""Values of radio-trace exports as column expressions: numbers, timestamps, types, generations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalloom import dims

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_CLOCK = r"(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?"
_ZONED = (
    r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
    r"(?:Z|[+-]\d{2}:\d{2})$"
)

# Layouts in order of preference, and the order of their groups as year-month-day.
_LAYOUTS = [
    (_ZONED, "$1-$2-$3 $4:$5:$6.$7"),
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:\s+|T){_CLOCK}Z?$", "$1-$2-$3 $4:$5:$6.$7"),
    (rf"^(\d{{1,2}})[-/](0?[1-9]|1[0-2])[-/](\d{{4}})\s+{_CLOCK}$", "$3-$2-$1 $4:$5:$6.$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_CLOCK}$", "$3-$1-$2 $4:$5:$6.$7"),
    (r"^(\d{4})(\d{2})(\d{2})\s*(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6."),
    (
        r"^.*?(\d{4})[-/](\d{1,2})[-/](\d{1,2})[\sT](\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?.*$",
        "$1-$2-$3 $4:$5:$6.$7",
    ),
]


def first_number(value: Column) -> Column:
    """First number in a text such as ``-95.5 dBm``."""
    return F.regexp_extract(value, r"[-+]?\d*\.?\d+", 0).try_cast("double")


def zone_offset(zone: str | None) -> int:
    """Offset in seconds of a zone name; +3 h for unknown names."""
    return dims.ZONE_OFFSETS.get(zone or dims.DEFAULT_ZONE, 10800)


def parse_timestamp(value: Column, zone: str | None = None) -> Column:
    """Epoch in microseconds of a time given as epoch seconds or milliseconds, ISO text with a zone,
    a local layout (day before month where both fit) or a local time inside a longer text.

    The text is brought into one layout by the first pattern it fits and read once.
    """
    text = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    epoch = F.when(
        (number > 946684800) & (number < 4102444800), F.round(number * 1e6).cast("bigint")
    ).when(
        (number > 946684800000) & (number < 4102444800000), F.round(number * 1e3).cast("bigint")
    )
    same = None
    for pattern, order in _LAYOUTS:
        moved = F.regexp_replace(text, pattern, order)
        hit = text.rlike(pattern)
        same = F.when(hit, moved) if same is None else same.when(hit, moved)
    shift = F.when(text.endswith("Z"), 0).otherwise(
        F.regexp_extract(text, r"([+-]\d{2}):\d{2}$", 1).try_cast("int") * 3600
        + F.concat(
            F.substring(text, -6, 1), F.regexp_extract(text, r"[+-]\d{2}:(\d{2})$", 1)
        ).try_cast("int")
        * 60
    )
    offset = F.when(text.rlike(_ZONED), shift).otherwise(zone_offset(zone))
    padded = F.regexp_replace(same, r"([- :])(\d)(?=[- :.])", "$10$2")
    padded = F.regexp_replace(F.regexp_replace(padded, r":\.$", ":00"), r"\.$", "")
    moment = padded.try_cast("timestamp_ntz")
    micros = F.timestamp_diff(
        "MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), moment
    )
    return F.coalesce(epoch, micros - offset.cast("bigint") * 1_000_000)


def zone_hint(value: Column) -> Column:
    """Zone a timestamp text names: a trailing ``+HH:MM``, else a known zone name in it."""
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    pattern = r"([+-])(\d{2}):(\d{2})$"
    hours = F.regexp_extract(text, pattern, 2).try_cast("int") * F.when(
        F.regexp_extract(text, pattern, 1) == "-", -1
    ).otherwise(1)
    offset = (
        F.when(hours == 3, "Asia/Qatar")
        .when(hours == 0, "UTC")
        .otherwise(
            F.concat(F.lit("UTC"), F.when(hours > 0, "+").otherwise(""), hours.cast("string"))
        )
    )
    named = dims.first_match(text, [(z, z) for z in dims.ZONE_OFFSETS])
    return F.when(text.rlike(pattern), offset).otherwise(named)


def classify_event(event_type: Column, label: Column) -> Column:
    """Known type of a radio event by words in its type and label, else the type as given."""
    text = F.upper(F.concat_ws(" ", event_type, F.coalesce(label, F.lit(""))))
    words = [(w, kind) for kind, group in dims.RADIO_EVENT_WORDS for w in group]
    kept = F.coalesce(F.nullif(event_type, F.lit("")), F.lit("UNKNOWN"))
    return F.coalesce(dims.first_match(text, words), kept)


def infer_generation(
    cells: Column, event_type: Column, label: Column, earfcn: Column, nrarfcn: Column
) -> Column:
    """Struct (generation, rat): a cell equal to a hint, else a hint inside type and label, else the
    kind of channel number."""
    text = F.upper(F.concat_ws(" ", event_type, F.coalesce(label, F.lit(""))))
    upper = F.transform(cells, lambda c: F.upper(F.trim(c)))
    hints = F.expr(f"array({dims.sql_list(list(dims.GENERATION_HINTS))})")
    cell = F.get(F.filter(upper, lambda c: F.array_contains(hints, c)), F.lit(0))
    word = dims.first_match(text, [(h, h) for h in dims.GENERATION_HINTS])
    hint = F.coalesce(
        cell,
        word,
        F.when(nrarfcn.isNotNull(), "NR").when(earfcn.isNotNull(), "LTE"),
    )
    return generation_of_hint(hint)


def generation_of_hint(hint: Column) -> Column:
    """Struct (generation, rat) of a hint; UNKNOWN for others."""
    pairs = dims.GENERATION_HINTS
    return F.struct(
        F.coalesce(dims.lookup({k: v[0] for k, v in pairs.items()}, hint), F.lit("UNKNOWN")).alias(
            "generation"
        ),
        F.coalesce(dims.lookup({k: v[1] for k, v in pairs.items()}, hint), F.lit("UNKNOWN")).alias(
            "rat"
        ),
    )


def handover_info(event_type: Column, cell_id: Column) -> Column:
    """Struct (attempt, success, from_cell, to_cell) of a handover event, else NULL."""
    text = F.upper(event_type)
    return F.when(
        text.contains("HO"),
        F.struct(
            F.lit(True).alias("attempt"),
            text.contains("SUCCESS").alias("success"),
            F.coalesce(cell_id, F.lit("")).alias("from_cell"),
            F.lit("").alias("to_cell"),
        ),
    )


def paging_info(event_type: Column, row_text: Column) -> Column:
    """Struct (attempt, success) of a paging event, successful if any value of the row says so."""
    return F.when(
        F.upper(event_type).contains("PAGING"),
        F.struct(
            F.lit(True).alias("attempt"),
            F.upper(row_text).contains("SUCCESS").alias("success"),
        ),
    )


def harq_nack(payload: Column) -> Column:
    """Highest HARQ NACK count in a payload text, else NULL."""
    counts = F.regexp_extract_all(payload, F.lit(r"(?i)nack_(?:256|64)_?qam>?(\d+)"), F.lit(1))
    return F.array_max(F.transform(counts, lambda n: n.try_cast("int")))


def tag_values(text: Column) -> Column:
    """Map of the ``<key>value</key>`` pairs of a text, keys in lower case, without internal and msg; a
    later pair of the same key wins."""
    pattern = r"<([^>]+)>([^<]*)</\1>"
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.transform(
        F.arrays_zip(keys.alias("k"), values.alias("v")),
        lambda p: F.struct(F.lower(F.trim(p["k"])).alias("k"), F.trim(p["v"]).alias("v")),
    )
    wanted = F.filter(pairs, lambda p: ~p["k"].isin("", "internal", "msg"))
    names = F.array_distinct(F.transform(wanted, lambda p: p["k"]))
    last = F.transform(
        names,
        lambda n: F.element_at(F.filter(wanted, lambda p: p["k"] == n), -1)["v"],
    )
    return F.map_from_arrays(names, last)
