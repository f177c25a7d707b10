"""Radio-trace exports (CSV, JSON, XML, HTML, diagram text) as rows of strings.

A path names a file or a folder of files. Delimiter, encoding, header, event list, row element and page kind are
decided for each file from the whole of it. Every reader adds trace_id (path below the folder, without extension) and
row_no (order inside the file).
"""

from __future__ import annotations

import html.parser
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.parsers import expat

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.radio import tag_values
from signalloom.operators.radio import SYNONYMS, normalize_rows, radio_summary
from signalloom.sources.delimited import name_of_file, position, read_delimited, spellings

# Names of lists that hold events, and file extensions.
EVENT_LISTS = [
    "events",
    "data",
    "records",
    "rows",
    "results",
    "traces",
    "measurements",
    "entries",
    "items",
    "logs",
]
FORMATS = {"html": "html", "htm": "html", "csv": "csv", "json": "json", "xml": "xml"}


def _numbered(rows: DataFrame) -> DataFrame:
    """Replace the position columns by one bigint that keeps the order within a trace.

    Rows of a block share a partition, so their ids fit below the block start in one number. Blocks of at least
    4 KB are told apart, in files of up to 4 TB.
    """
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    row_no = F.shiftleft(F.expr("_block div 4096"), 33) + place
    return rows.withColumn("row_no", row_no).drop("_file", "_block", "_at")


def read_radio_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header per file (:func:`signalloom.sources.delimited.read_delimited`)."""
    return _numbered(read_delimited(spark, path))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: trace_id, _file and its text as page."""
    text = F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", "")
    files = spark.read.text(path, wholetext=True)
    return files.select(name_of_file(path).alias("trace_id"), F.col("_metadata.file_path").alias("_file"), text.alias("page"))


def _event_list(node: dict, depth: int = 4) -> list:
    """The list of events in nested objects: of a level's own lists of objects one of a known name, else the longest;
    a list further down, at most ``depth`` levels, if it is longer still."""
    own = [(k, v) for k, v in node.items() if isinstance(v, list) and v and isinstance(v[0], dict)]
    best = max(own, key=lambda kv: (kv[0].lower() in EVENT_LISTS, len(kv[1])), default=("", []))[1]
    if depth:
        below = [_event_list(v, depth - 1) for v in node.values() if isinstance(v, dict)]
        best = max([best, *below], key=len)
    return best


def json_rows(text: str) -> list[dict[str, str]]:
    """Rows of one JSON text: its objects if it is a list, else the event list in it. Numbers stay as written; a text
    that is no JSON has no rows."""
    try:
        data = json.loads(text, parse_float=str, parse_int=str)
    except json.JSONDecodeError:
        return []
    rows = _event_list(data) if isinstance(data, dict) else data if isinstance(data, list) else []
    return _cells(rows)


def _cells(rows: list) -> list[dict[str, str]]:
    return [
        {k: v if isinstance(v, str) else json.dumps(v) for k, v in row.items() if v is not None}
        for row in rows
        if isinstance(row, dict)
    ]


def read_radio_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects per file, or objects holding one (:func:`json_rows`). A file is read by one task."""
    return _wide(_rows_of_pages(whole_files(spark, path), json_rows))


class _Rows:
    """Finds the row element (:func:`row_element`) of an XML text that comes in pieces."""

    def __init__(self, depth: int) -> None:
        self._depth = depth
        self._opened: list[tuple[int, Counter]] = []
        self._best = (1, 0, None)
        self._seen = 0
        self._bad = False
        self._parser = expat.ParserCreate()
        self._parser.StartElementHandler, self._parser.EndElementHandler = self._start, self._end

    def _start(self, tag: str, _: dict) -> None:
        self._seen += 1
        # what is deeper than any row is not counted
        if self._opened and len(self._opened) <= self._depth + 1:
            self._opened[-1][1][tag] += 1
        self._opened.append((self._seen, Counter()))

    def _end(self, _: str) -> None:
        at, children = self._opened.pop()
        if len(self._opened) <= self._depth and children:
            tag, times = children.most_common(1)[0]
            if times >= 2:
                self._best = max(self._best, (times, -at, tag), key=lambda b: b[:2])

    def feed(self, text: str, last: bool = False) -> None:
        if not self._bad:
            try:
                self._parser.Parse(text.encode(), last)
            except expat.ExpatError:
                self._bad = True

    def found(self) -> str | None:
        self.feed("", True)
        return None if self._bad else self._best[2]


def row_element(text: str, depth: int = 3) -> str | None:
    """The element repeated most often below one parent, at most ``depth`` levels under the root; of equal ones that
    of the outer or earlier parent. None if nothing repeats or the text is no XML."""
    rows = _Rows(depth)
    rows.feed(text)
    return rows.found()


# Characters of one piece of an XML text.
PIECE = 16_384


def _xml_pieces(spark: SparkSession, path: str) -> DataFrame:
    """XML files in pieces of some KB: _file, _block, _at, piece. Files are read in blocks and split behind tags, so a
    piece is a run of tags; ``>`` stands before each tag's rest, and what ends the file is told by ``_at``."""
    tags = spark.read.text(path, lineSep=">").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.make_valid_utf8("value").alias("value"),
    )

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, at, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for file, block, value in zip(batch["_file"], batch["_block"], batch["value"], strict=True):
                if held and (place != (file, block) or size > PIECE):
                    out.append((*place, at, ">".join(held)))
                    at, held, size = at + 1, [], 0
                if place != (file, block):
                    place, at = (file, block), 0
                held.append(value)
                size += len(value) + 1
            if out:
                yield pd.DataFrame(out, columns=["_file", "_block", "_at", "piece"])
        if held:
            yield pd.DataFrame([(*place, at, ">".join(held))], columns=["_file", "_block", "_at", "piece"])

    return tags.mapInPandas(gather, "_file string, _block long, _at long, piece string")


def _row_elements(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their row element; names only reach the driver. A file passes one task piece by piece."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, rows, end = None, None, ""

        def named() -> pd.DataFrame:
            # the last tag of a file that ends with it has lost its end
            if end.rpartition(">")[2].lstrip().startswith("<"):
                rows.feed(">")
            return pd.DataFrame({"file": [file], "tag": [rows.found()]})

        for batch in batches:
            for name, piece in zip(batch["_file"], batch["piece"], strict=True):
                if name != file:
                    if rows:
                        yield named()
                    file, rows, end = name, _Rows(3), ""
                    rows.feed(piece.removeprefix("\ufeff"))
                else:
                    rows.feed(">" + piece)
                end = piece
        if rows:
            yield named()

    pieces = _xml_pieces(spark, path).repartition("_file").sortWithinPartitions("_file", "_block", "_at")
    found = pieces.select("_file", "piece").mapInPandas(find, "file string, tag string")
    files: dict[str, list[str]] = defaultdict(list)
    for row in found.filter("tag is not null").orderBy("file").collect():
        files[row["tag"]].append(unquote(row["file"]))
    return files


def read_radio_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """XML rows: the elements of ``row_tag``, else per file of its most repeated one (:func:`row_element`); attributes,
    child texts and one nested level (``child.sub``) become columns."""
    files = {row_tag: [path]} if row_tag else _row_elements(spark, path)
    if not files:
        raise ValueError(f"no repeated element in the XML at {path}")
    out = None
    for tag, paths in files.items():
        rows = _numbered(_xml_rows(spark, path, paths, tag))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _xml_rows(spark: SparkSession, path: str, paths: list[str], tag: str) -> DataFrame:
    raw = (
        spark.read.format("xml")
        .option("rowTag", tag)
        .option("inferSchema", True)
        .option("prefersDecimal", False)
        .load(paths)
    )
    columns = []
    for field in raw.schema.fields:
        ref = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            for sub in field.dataType.fields:
                text = field.name if sub.name == "_VALUE" else f"{field.name}.{sub.name.lstrip('_')}"
                columns.append(ref.getField(sub.name).cast("string").alias(text))
        else:
            name = "_text" if field.name == "_VALUE" else field.name.lstrip("_")
            columns.append(ref.cast("string").alias(name))
    return raw.select(*position(path), *columns)


class _Page(html.parser.HTMLParser):
    """Collects the script texts and table rows of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.scripts: list[str] = []
        self.tables: list[list[list[str]]] = []
        self._open: list[list[list[str]]] = []
        self._cell: list[str] | None = None
        self._script: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script":
            self._script = []
        elif tag == "table":
            self._open.append([])
            self.tables.append(self._open[-1])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open and self._open[-1]:
            self._cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._script is not None:
            self.scripts.append("".join(self._script).strip())
            self._script = None
        elif tag == "table" and self._open:
            self._open.pop()
        elif tag in ("td", "th") and self._cell is not None:
            if self._open and self._open[-1]:
                self._open[-1][-1].append("".join(part.strip() for part in self._cell))
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)
        elif self._cell is not None:
            self._cell.append(data)


def _script_rows(text: str) -> list[dict] | None:
    for opened, closed in ("[]", "{}"):
        start, end = text.find(opened), text.rfind(closed)
        if not 0 <= start < end:
            continue
        try:
            data = json.loads(text[start : end + 1])
        except json.JSONDecodeError:
            continue
        lists = [data] if isinstance(data, list) else list(data.values())
        for rows in lists:
            if isinstance(rows, list) and rows and isinstance(rows[0], dict):
                return rows
    return None


def page_rows(page: str) -> list[dict[str, str]]:
    """Rows of one HTML page: JSON in a script, else the table with most rows (first row is the header;
    rows of another width are dropped)."""
    parsed = _Page()
    parsed.feed(page)
    for script in parsed.scripts:
        rows = _script_rows(script)
        if rows is not None:
            return _cells(rows)
    table = max(parsed.tables, key=len, default=[])
    if len(table) < 2 or not table[0]:
        return []
    header = table[0]
    return [dict(zip(header, row, strict=True)) for row in table[1:] if len(row) == len(header)]


def _rows_of_pages(pages: DataFrame, rows_of: Callable[[str], list[dict[str, str]]]) -> DataFrame:
    """Rows of pages (trace_id, page) as trace_id, row_no, cells map; pages in parallel."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (trace, i, row)
                for trace, page in zip(batch["trace_id"], batch["page"], strict=True)
                for i, row in enumerate(rows_of(page or ""))
            ]
            yield pd.DataFrame(out, columns=["trace_id", "row_no", "cells"])

    return pages.select("trace_id", "page").mapInPandas(extract, "trace_id string, row_no long, cells map<string,string>")


def html_rows(pages: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of HTML pages as (trace_id, row_no, cells map), pages in parallel."""
    return _rows_of_pages(
        pages.select(F.col(key).cast("string").alias("trace_id"), F.col(content).alias("page")), page_rows
    )


def _lower_keys(cells: Column) -> Column:
    """Map with lower-case keys; of keys that become equal the last one wins."""
    entries = F.map_entries(cells)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = F.transform(
        names,
        lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"],
    )
    return F.map_from_arrays(names, values)


def _wide(rows: DataFrame) -> DataFrame:
    """Map cells as columns where the name is that of a known column, the others as map ``raw``.

    Column names are header metadata; only the known ones are read on the driver.
    """
    known = [s for names in SYNONYMS.values() for s in names]
    low = F.lower(F.trim("k"))
    near = "|".join(re.escape(s) for s in known if len(s) >= 4)
    names = rows.select(F.explode(F.map_keys("cells")).alias("k"))
    names = names.filter(low.isin(known) | low.rlike(near)).distinct()
    found = sorted(r["k"] for r in names.collect())
    rest = F.map_filter("cells", lambda k, _: ~k.isin(found))
    return rows.select(
        "trace_id",
        "row_no",
        *spellings(found, lambda n: F.col("cells")[n]),
        _lower_keys(rest).alias("raw"),
    )


def read_radio_html(spark: SparkSession, path: str) -> DataFrame:
    """HTML exports, decided page by page: script JSON or the largest table; a page without either gives the events of
    its diagram lines."""
    rows = _rows_of_pages(whole_files(spark, path), page_rows)
    events = diagram_events(diagram_lines(spark, path))
    events = events.join(rows.select("trace_id").distinct(), "trace_id", "left_anti")
    return _wide(rows).unionByName(with_known_tags(events), allowMissingColumns=True)


def with_known_tags(rows: DataFrame) -> DataFrame:
    """Add a column for each tag in ``raw`` whose name is a known column name. Only these names, at
    most one per synonym, are read on the driver."""
    known = [s for names in SYNONYMS.values() for s in names]
    names = rows.select(F.explode(F.map_keys("raw")).alias("k")).filter(F.lower("k").isin(known))
    found = sorted(r["k"] for r in names.distinct().collect())
    new = [n for n in found if n.lower() not in {c.lower() for c in rows.columns}]
    return rows.withColumns({n: F.col("raw")[n] for n in new}) if new else rows


def diagram_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their order: trace_id, _block, _at, value. Large files are split."""
    return spark.read.text(path).select(*position(path), "value")


def diagram_events(lines: DataFrame) -> DataFrame:
    """Events of diagram lines ``A->B: {json}``: a datetime line sets the clock of the event lines after
    it; an event carries the node pair, the message and the decoded tags of its link.

    The clock is carried forward within each file block; a block that starts without one takes the
    last clock of the blocks before it, of which there is one row per block.
    """
    from pyspark.sql import Window

    shape = "type string, message string, url string"
    text = F.trim("value")
    start = F.locate("{", text)
    rows = lines.filter(text.endswith("}") & (start > 0)).withColumns(
        {
            "_j": F.from_json(F.expr("substring(trim(value), locate('{', trim(value)))"), shape),
            "_head": F.expr("trim(substring(trim(value), 1, locate('{', trim(value)) - 1))"),
        }
    )
    rows = rows.filter("_j.type in ('datetime', 'event')").withColumn(
        "_clock", F.when(F.col("_j.type") == "datetime", F.col("_j.message"))
    )
    block = ["trace_id", "_block"]
    inside = Window.partitionBy(*block).orderBy("_at")
    before = Window.partitionBy("trace_id").orderBy("_block")
    ends = (
        rows.filter("_clock is not null")
        .groupBy(*block)
        .agg(F.max_by("_clock", "_at").alias("_end"))
    )
    starts = (
        rows.select(*block)
        .distinct()
        .join(ends, block, "left")
        .withColumn(
            "_start",
            F.last("_end", ignorenulls=True).over(
                before.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_end")
    )
    timed = rows.withColumn("_in", F.last("_clock", ignorenulls=True).over(inside))
    timed = timed.filter("_j.type = 'event'").join(starts, block, "left")
    pair = F.split(F.regexp_replace("_head", ":+$", ""), "->")

    def node(i: int) -> Column:
        name = F.regexp_replace(F.get(pair, F.lit(i)), "^[\"' ]+|[\"' ]+$", "")
        return F.when(F.size(pair) == 2, name)

    link = F.regexp_extract("_j.url", r"updateEventMessage\('([^']+)'\)", 1)
    body = F.replace(F.try_url_decode(link), F.lit("\\n"), F.lit(" "))
    cause = F.regexp_extract(
        body, r"(?i)<Cause>\s*<radioNetwork>([^<]+)</radioNetwork>\s*</Cause>", 1
    )
    out = timed.select(
        "trace_id",
        "_block",
        "_at",
        F.coalesce("_in", "_start").alias("Time"),
        F.coalesce("_j.message", F.lit("Unknown")).alias("Message"),
        node(0).alias("from_node"),
        node(1).alias("to_node"),
        F.nullif(cause, F.lit("")).alias("release_cause"),
        F.coalesce(tag_values(body), F.create_map().cast("map<string,string>")).alias("raw"),
    )
    return _numbered(out)


def read_radio(spark: SparkSession, path: str) -> DataFrame:
    """Rows of radio-trace exports: one file, or all files of known formats below a folder, each read by its
    extension. With several formats, trace_id ends in that of its file."""
    readers = {"csv": read_radio_csv, "json": read_radio_json, "xml": read_radio_xml, "html": read_radio_html}
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension in FORMATS:
        return readers[FORMATS[extension]](spark, path)
    try:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as problem:
        raise ValueError(f"unsupported format {extension!r}; a folder or one of {sorted(FORMATS)}") from problem
    kinds = names.select(F.regexp_extract("path", r"\.([^./]*)$", 1).alias("kind")).distinct().collect()
    kinds = sorted({r["kind"] for r in kinds if r["kind"].lower() in FORMATS})
    if not kinds:
        raise ValueError(f"unsupported formats at {path}; use {sorted(FORMATS)}")
    out = None
    for kind in kinds:
        rows = readers[FORMATS[kind.lower()]](Below(spark, kind), path)
        if len(kinds) > 1:
            rows = rows.withColumn("trace_id", F.concat("trace_id", F.lit(f".{kind}")))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


class Below:
    """Stands in for a session: its reader takes the files of one extension in a folder and the folders in it."""

    def __init__(self, spark: SparkSession, kind: str) -> None:
        self._spark, self._kind = spark, kind

    @property
    def read(self):
        return self._spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{self._kind}")


def ingest_radio(
    spark: SparkSession, path: str, out: str, zone: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Read an export, normalise it, write events and summary below ``out``, return both as written."""
    events = normalize_rows(read_radio(spark, path), zone)
    events.write.mode("overwrite").parquet(f"{out}/radio_events")
    stored = spark.read.parquet(f"{out}/radio_events")
    if stored.isEmpty():
        raise ValueError("no valid events after normalization")
    radio_summary(stored).write.mode("overwrite").json(f"{out}/radio_summary")
    return stored, spark.read.json(f"{out}/radio_summary")
