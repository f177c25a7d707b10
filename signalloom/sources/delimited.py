"""Delimited text, many files at a time, each with its own header, delimiter and encoding.

Files are read as lines and split into blocks as Spark likes. A record with line breaks in quotes is several lines: each
line maps the state it starts in (outside or inside quotes) to the one it ends in, and such maps compose, first over the
lines of a block and then over blocks. So every line learns the state it starts in, whichever block it is in. Only files
in which some line ends inside quotes take this way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.session import stored

DELIMITERS = [",", ";", "\t", "|"]
POSITION = ["_file", "_block", "_at"]


def name_of_file(path: str, file: str = "_metadata.file_path", bare: str = "_metadata.file_name") -> Column:
    """Name of the current row's file: its path below ``path`` without extension, so that equal names in different
    folders differ; the bare name where ``path`` is the file or a pattern."""
    below = F.regexp_extract(F.col(file), rf"\Q{path.rstrip('/')}\E/(.+?)(\.[^./]*)?$", 1)
    name = F.regexp_extract(F.col(bare), r"^(.*?)(\.[^.]*)?$", 1)
    return F.coalesce(F.nullif(below, F.lit("")), name)


def position(path: str) -> list[Column]:
    """Trace and file of a row, and its order there: start of the file block it was read from, then its place in it."""
    return [
        name_of_file(path).alias("trace_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    ]


def _open(line: Column, sep: str) -> Column:
    """Whether a line that starts outside quotes ends inside: a field that starts with a quote and is not closed."""
    d = re.escape(sep)
    left = F.regexp_replace(line, rf'(^|{d})"(?:[^"]++|"")*+"', "$1")
    return F.contains(line, F.lit('"')) & left.rlike(rf'(^|{d})"')


def _stays(line: Column, sep: str) -> Column:
    """Whether a line that starts inside quotes ends inside quotes."""
    close = r'^(?:[^"]++|"")*+"'
    return F.when(line.rlike(close), _open(F.concat(F.lit("x"), F.regexp_replace(line, close, "")), sep)).otherwise(True)


def _by_sep(delimiters: list[str], of: Callable[[str], Column]) -> Column:
    return F.coalesce(*[F.when(F.col("_sep") == d, of(d)) for d in delimiters])


def _whole_records(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    """Lines of torn files (with ``_sep``, and ``_o``: whether a line that starts outside quotes ends inside) as records:
    lines inside quotes are joined to the one that opened them, by line feeds. Where a quote is never closed, its lines stay
    apart.

    One pass over the text finds, for a block that starts outside (0) and inside quotes (1), the state before each line and
    where its record starts. Then blocks are put in order, one row a block, and each line takes the answer of its block's
    start."""
    stays = _by_sep(delimiters, lambda d: _stays(F.col("value"), d)).cast("int")
    lines = lines.withColumn("_o", F.col("_o").cast("int")).withColumn("_i", stays)
    own = [c for c in lines.columns if c not in {*POSITION, "value"} and not c.startswith("_")]
    # a line sets the state (equal ends from both starts), turns it over, or leaves it
    lines = lines.withColumn("_set", F.expr("IF(_o = _i, _o, NULL)")).withColumn("_flip", F.expr("IF(_o = 1 AND _i = 0, 1, 0)"))

    def state(rows: DataFrame, window, starts: dict[str, Column]) -> DataFrame:
        """The state before each row of the window's order, for each start."""
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_sum", F.sum("_flip").over(upto))
        rows = rows.withColumn("_anchor", F.expr("pmod(_set - _sum, 2)"))
        past = F.last("_anchor", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_past", past)
        return rows.withColumns(
            {name: F.expr("pmod(coalesce(_past, {0}) + _sum - _flip, 2)".format(start)) for name, start in starts.items()}
        )

    inside = Window.partitionBy("_file", "_block").orderBy("_at")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = state(lines, inside, {"_b0": "0", "_b1": "1"}).select(
        *own,
        *POSITION,
        "value",
        "_sep",
        "_o",
        "_i",
        "_b0",
        "_b1",
        *[F.last(F.when(F.col(f"_b{s}") == 0, F.col("_at")), ignorenulls=True).over(upto).alias(f"_h{s}") for s in (0, 1)],
        F.lead(F.lit(1)).over(inside).isNull().alias("_end"),
    )
    lines = stored(lines)

    ends = [f"IF(_b{s} = 0, _o, _i) AS _e{s}" for s in (0, 1)]
    blocks = lines.filter("_end").selectExpr("_file", "_block", "_h0", "_h1", *ends)
    blocks = blocks.withColumn("_set", F.expr("IF(_e0 = _e1, _e0, NULL)")).withColumn("_flip", F.expr("IF(_e0 = 1 AND _e1 = 0, 1, 0)"))
    across = Window.partitionBy("_file").orderBy("_block")
    blocks = state(blocks, across, {"_start": "0"})
    # where a record that is open at the start of a block began: perhaps several blocks before
    last = F.expr("IF(_start = 0, _h0, _h1)")
    last = F.when(last.isNotNull(), F.struct("_block", last.alias("_at")))
    carried = F.last(last, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    blocks = stored(blocks.select("_file", "_block", "_start", carried.alias("_carried")))

    lines = lines.join(blocks, ["_file", "_block"]).withColumn("_before", F.expr("IF(_start = 0, _b0, _b1)"))
    head = F.expr("IF(_start = 0, _h0, _h1)")
    head = F.coalesce(F.when(head.isNotNull(), F.struct("_block", head.alias("_at"))), F.col("_carried"))
    lines = lines.withColumn("_head", head).withColumn("_after", F.expr("IF(_before = 0, _o, _i)"))
    torn = (F.col("_before") == 1) | (F.col("_after") == 1)
    place = F.struct("_block", "_at")
    groups = (
        lines.filter(torn)
        .groupBy("_file", "_head", "_sep", *own)
        .agg(
            F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("_lines"),
            (F.max_by("_after", place) == 0).alias("_closed"),
        )
    )
    joined = F.struct(F.col("_head._block").alias("_block"), F.col("_head._at").alias("_at"), F.array_join("_lines.value", "\n").alias("value"))
    groups = groups.withColumn("_x", F.explode(F.when(F.col("_closed"), F.array(joined)).otherwise(F.col("_lines"))))
    names = [*own, "_file"]
    return groups.select(*names, "_x.*").unionByName(lines.filter(~torn).select(*names, "_block", "_at", "value"))


def _files(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    """One row per file with text: its first line and where that is, its delimiter, whether it is UTF-8, whether a record of
    it is torn by a line break, and whether the first one is."""
    full = F.trim("value") != ""
    torn = [f"_o{i}" for i in range(len(delimiters))]
    # numbers and flags only, so that rows are reduced by hash before the shuffle
    blocks = lines.groupBy("_file", "_block", "_bare").agg(
        F.min(F.when(full, F.col("_at"))).alias("_at"),
        F.bool_and("_valid").alias("_valid"),
        *[F.bool_or(c).alias(c) for c in torn],
    )
    place = F.struct("_block", "_at")
    files = blocks.groupBy("_file", "_bare").agg(
        F.min(F.when(F.col("_at").isNotNull(), place)).alias("_first"),
        F.bool_and("_valid").alias("_utf8"),
        *[F.bool_or(c).alias(c) for c in torn],
    )
    files = stored(files.filter("_first is not null").select("*", "_first.*"))
    first = lines.select(*POSITION, F.col("value").alias("_line"), *[F.col(c).alias(f"_head{c}") for c in torn])
    files = files.join(first, POSITION)
    bare = F.regexp_replace("_line", '"[^"]*"', "")
    times = {d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in delimiters}
    ranked = [F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, (d, n) in enumerate(times.items())]
    files = files.withColumn("_sep", F.array_max(F.array(*ranked))["d"])
    for name, flag in (("_torn", "_o"), ("_torn_head", "_head_o")):
        files = files.withColumn(name, _by_sep(delimiters, lambda d, flag=flag: F.col(f"{flag}{delimiters.index(d)}")))
    return stored(files.select("_file", "_bare", "_utf8", "_sep", "_torn", "_torn_head", "_first", "_line"))


def read_delimited(spark: SparkSession, path: str, delimiters: list[str] = DELIMITERS) -> DataFrame:
    """Rows of all files at ``path`` with trace_id, the position columns, folder columns and a column of strings per header name.

    Per file, the first line tells the delimiter (whichever it has most of), and the whole file the encoding: UTF-8 if
    all its lines are valid, else Latin-1. Files of other columns share the table by name; what a file lacks is NULL.
    Blank lines are skipped, line breaks in quotes are kept as line feeds. Only header names are read on the driver.
    The files are read once, into a table of lines in the shared folder; lines of torn files are written once more."""
    text = spark.read.text(path)
    folders = [c for c in text.columns if c != "value"]
    opens = [F.coalesce(_open(F.col("value"), d), F.lit(False)).alias(f"_o{i}") for i, d in enumerate(delimiters)]
    place = position(path)[1:]
    lines = text.select(*[F.col(c).cast("string").alias(c) for c in folders], *place, F.col("_metadata.file_name").alias("_bare"), "value")
    lines = stored(lines.select("*", F.is_valid_utf8("value").alias("_valid"), *opens))
    files = _files(lines, delimiters)
    order = F.struct("_block", "_at")
    full = F.trim("value") != ""

    kept = [*POSITION, *folders, "value"]
    records = lines.join(files.filter("not _torn").select("_file"), "_file").select(*kept)
    heads = files
    if not files.filter("_torn").isEmpty():
        marked = lines.join(files.filter("_torn").select("_file", "_sep"), "_file")
        opened = _by_sep(delimiters, lambda d: F.col(f"_o{delimiters.index(d)}"))
        whole = _whole_records(marked.select(*kept, "_sep", opened.alias("_o")), delimiters).select(*kept)
        records = records.unionByName(whole)
        if not files.filter("_torn_head").isEmpty():
            first = files.filter("_torn_head").select("_file", "_first.*")
            joined = whole.join(first, POSITION).select("_file", F.col("value").alias("_joined"))
            heads = heads.join(joined, "_file", "left")
            heads = stored(heads.withColumn("_line", F.coalesce("_joined", "_line")).drop("_joined"))

    def decoded(text: str) -> Column:
        latin = F.decode(F.col(text).cast("binary"), "ISO-8859-1")
        return F.when(F.col("_utf8"), F.col(text)).otherwise(latin)

    # names and places are found once for the file
    trace = name_of_file(path, "_file", "_bare").alias("trace_id")
    heads = heads.select("_file", trace, "_utf8", "_sep", "_first", F.regexp_replace(decoded("_line"), "^﻿", "").alias("_line"))
    bare = F.regexp_replace("_line", '"[^"]*"', "")
    spread = _by_sep(delimiters, lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))))
    width = heads.agg(F.max(spread)).first()[0]
    if width is None:
        raise ValueError(f"no rows at {path}")
    shape = ", ".join(f"_c{i} string" for i in range(width + 1))

    def split(line: Column) -> Column:
        def parts(sep: str) -> Column:
            # as the one element of an array, so that a line is parsed once for all its cells
            row = F.array(F.from_csv(line, shape, {"sep": sep, "escape": '"', "lineSep": "\x00"}))
            return F.transform(row, lambda r: F.array(*[r[f"_c{i}"] for i in range(width + 1)]))[0]

        return _by_sep(delimiters, parts)

    heads = heads.withColumn("_names", F.transform(split(F.col("_line")), F.trim)).drop("_line")
    named = heads.select(F.posexplode("_names").alias("place", "name")).filter("name <> ''")
    found = named.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()
    names = [r["name"] for r in found if r["name"] not in folders]
    places = F.array(*[F.array_position("_names", F.lit(n)).cast("int") - 1 for n in names]).cast("array<int>")
    heads = stored(heads.select("_file", "trace_id", "_utf8", "_sep", "_first", places.alias("_places")))
    rows = records.filter(full).join(heads, "_file").filter(order != F.col("_first")).withColumn("_cells", split(decoded("value")))
    at = {n: i for i, n in enumerate(names)}
    cells = spellings(names, lambda n: F.get("_cells", F.get("_places", F.lit(at[n]))))
    return rows.select("trace_id", *POSITION, *folders, *cells)


def spellings(names: list[str], value: Callable[[str], Column]) -> list[Column]:
    """One column per name; names that differ in case only are one column, the first one's."""
    groups: dict[str, list[str]] = defaultdict(list)
    for name in names:
        groups[name.lower()].append(name)
    return [F.coalesce(*map(value, same)).alias(same[0]) for same in groups.values()]
