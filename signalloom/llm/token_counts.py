"""Token counts per document by a two-tier lookup (dealt operator 2).

The first tier, a compact table of the corpus's frequent pre-tokens and their token counts, is broadcast; what
it lacks is encoded where it occurs and kept in a bounded cache of the worker. Pre-tokens are never shuffled:
each task summarises the chunks it saw in one bounded row, and those rows are merged by a tree.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.store import stored
from signalloom.llm.tokens import WordEndCounts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _packed(counts: Counter, size: int) -> bytes:
    kept = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return zlib.compress(json.dumps(dict(kept)).encode(), 1)


def _unpacked(blob: bytes) -> Counter:
    return Counter(json.loads(zlib.decompress(blob)))


def frequent_pretokens(docs: DataFrame, vocabulary: str, size: int, fan_in: int = 16) -> dict[str, int]:
    """Token counts of about the ``size`` most frequent pre-tokens of all texts.

    Every text is counted. A task's counter is cut to its ``4 * size`` highest counts when it doubles that, and
    to ``2 * size`` in its summary row; ``fan_in`` summaries are merged by a task until ``fan_in`` rows are left.
    The table only decides what is looked up where, never a count."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = WordEndCounts(vocabulary, {})
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.text:
                counts.update(splitter.chunks(text))
                if len(counts) > 8 * size:
                    counts = Counter(dict(counts.most_common(4 * size)))
        words: Counter = Counter()
        for chunk, n in counts.items():
            for word in splitter.pattern.findall(chunk):
                words[word] += n
        if words:
            yield pd.DataFrame({"summary": [_packed(words, 2 * size)]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for blob in group.summary:
            total.update(_unpacked(blob))
        return pd.DataFrame({"part": [int(group.part.iloc[0]) // fan_in], "summary": [_packed(total, 2 * size)]})

    texts = docs.select("text").where("text is not null")
    rows = texts.mapInPandas(summarise, "summary binary").select(F.spark_partition_id().cast("long").alias("part"), "summary")
    rows = stored(rows)
    parts = rows.agg(F.max("part")).first()[0]
    while parts is not None and parts >= fan_in:
        rows = stored(rows.groupBy(F.floor(F.col("part") / fan_in).alias("above")).applyInPandas(merge, "part long, summary binary"))
        parts //= fan_in
    total: Counter = Counter()
    for row in rows.select("summary").collect():  # at most fan_in bounded rows
        total.update(_unpacked(row.summary))
    counter = WordEndCounts(vocabulary, {})
    return {w: counter.word(w) for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, table_size: int = 65_536) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): UTF-8 bytes, tokens as the library counts them, and whether there
    are more than ``limit``.

    ``table_size`` bounds the broadcast table. Null text counts as empty (no bytes, no tokens). Null ids and
    repeated rows stay. Extra columns are ignored. Empty input gives no rows."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_pretokens(docs, vocabulary, table_size))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = WordEndCounts(vocabulary, table.value)
        for batch in batches:
            tokens = pd.Series([counter.count(t) for t in batch.text], dtype="int64")
            yield pd.DataFrame(
                {
                    "doc_id": batch.doc_id.astype("Int64"),
                    "n_bytes": batch.n_bytes,
                    "n_tokens": tokens,
                    "over_limit": tokens > limit,
                }
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInPandas(count, SCHEMA)
