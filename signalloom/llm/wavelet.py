"""Token ids in wavelet-matrix files (dealt operator 4).

A shard holds the ids of consecutive documents as a wavelet matrix: one bit-plane per bit of an id, from the
highest down, each plane ordered by the bits above it (zeros first, then ones). Rank samples beside each plane
answer, from one compressed shard: the id at a position (``access``), how often an id occurs before a position
(``count``) and where it occurs the n-th time (``locate``). Shards are Parquet files, one row per shard, so
Spark's commit protocol and compression apply.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.llm.store import shared_folder, stored
from signalloom.llm.tokens import worker_encoder

MAGIC = b"WMX2"
PACK = zstandard.ZstdCompressor(level=1)
#: Bits of a plane between two rank samples.
BLOCK = 512
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Rank and select over the ids of one shard. ``bits`` planes; ids are below ``2 ** bits``."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        zeros, planes, ranks = [], [], []
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << level)) != 0
            plane = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % BLOCK, bool)]), bitorder="little")
            per_block = np.bitwise_count(plane.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))
            zeros.append(int((~bit).sum()))
            # gathers by position are cheaper than by mask
            rest = np.concatenate([rest[np.flatnonzero(~bit)], rest[np.flatnonzero(bit)]])
        return cls(len(ids), bits, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        """Header, then per plane its zeros, rank samples and bits, all compressed."""
        out = [MAGIC, struct.pack("<QB", self.n, self.bits)]
        for zeros, plane, ranks in zip(self.zeros, self.planes, self.ranks, strict=True):
            bits = PACK.compress(plane.tobytes())
            samples = PACK.compress(np.diff(ranks).astype("<u2").tobytes())
            out.append(struct.pack("<QII", zeros, len(samples), len(bits)) + samples + bits)
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QB", data, 4)
        at, zeros, planes, ranks = 13, [], [], []
        for _ in range(bits):
            zero, samples, plane = struct.unpack_from("<QII", data, at)
            at += 16
            steps = np.frombuffer(zstandard.decompress(data[at : at + samples]), "<u2")
            ranks.append(np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]))
            planes.append(np.frombuffer(zstandard.decompress(data[at + samples : at + samples + plane]), np.uint8))
            zeros.append(zero)
            at += samples + plane
        return cls(n, bits, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        found = int(self.ranks[level][block])
        if rest:
            part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
            found += int(POPCOUNT[part[: rest // 8]].sum())
            if rest % 8:
                found += int(POPCOUNT[part[rest // 8] & ((1 << rest % 8) - 1)])
        return found

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i // 8]) >> (i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            value = value * 2 + bit
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of ``value`` among the first ``end`` ids (all by default)."""
        if value < 0 or value >> self.bits:
            return 0
        low, high = 0, self.n if end is None else min(end, self.n)
        for level in range(self.bits):
            ones = self._ones(level, low), self._ones(level, high)
            if (value >> (self.bits - 1 - level)) & 1:
                low, high = self.zeros[level] + ones[0], self.zeros[level] + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return high - low

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) such bit of a plane: rank samples, then one block."""
        samples = self.ranks[level]
        if not bit:
            samples = np.arange(len(samples), dtype=np.int64) * BLOCK - samples
        block = int(np.searchsorted(samples, k, side="right")) - 1
        bytes_ = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        inside = np.flatnonzero(np.unpackbits(bytes_, bitorder="little") == bit)
        return block * BLOCK + int(inside[k - int(samples[block])])

    def locate(self, value: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        low = 0
        for level in range(self.bits):
            ones = self._ones(level, low)
            low = self.zeros[level] + ones if (value >> (self.bits - 1 - level)) & 1 else low - ones
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = (value >> (self.bits - 1 - level)) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def to_array(self) -> np.ndarray:
        """All ids, in order: the planes are undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little")[: self.n].astype(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~bit)] = values[: self.zeros[level]]
            back[np.flatnonzero(bit)] = values[self.zeros[level] :]
            values = back | (bit.astype(kind) << kind(self.bits - 1 - level))
        return values


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, shard_ids: int = 1 << 20) -> None:
    """Encode ``docs`` (doc_id, text), put ``end_id`` after each, and write the ids in ascending order of doc_id
    (nulls first, equal ids by text) as shards of at least ``shard_ids`` ids; a document is never divided.

    Columns: part and place (their order is the order of the shards), n_ids, doc_ids, doc_lengths, matrix.
    Only texts are shuffled, once, by ranges of doc_id."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(vocabulary)
        names, lengths, ids, size, place = [], [], [], 0, 0

        def shard() -> pd.DataFrame:
            data = np.concatenate(ids)
            return pd.DataFrame(
                {"place": [place], "n_ids": [len(data)], "doc_ids": [names], "doc_lengths": [lengths], "matrix": [WaveletMatrix.build(data).to_bytes()]}
            )

        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                own = np.frombuffer(encoder.encode(text) + end_id.to_bytes(4, "little"), "<u4")
                names.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(own))
                ids.append(own)
                size += len(own)
                if size >= shard_ids:
                    yield shard()
                    names, lengths, ids, size, place = [], [], [], 0, place + 1
        if ids:
            yield shard()

    text = F.coalesce(F.col("text"), F.lit(""))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = rows.mapInPandas(build, "place long, n_ids long, doc_ids array<long>, doc_lengths array<long>, matrix binary")
    shards.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens (with its
    end id) and ids_crc32 of its ids as little-endian unsigned 32-bit integers.

    Shard totals are summed per part, and parts in order: one narrow row per part meets in one task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                ids = WaveletMatrix.from_bytes(row.matrix).to_array().astype("<u4")
                ends = np.cumsum(row.doc_lengths, dtype=np.int64)
                starts = ends - np.asarray(row.doc_lengths, np.int64)
                yield pd.DataFrame(
                    {
                        "part": row.part,
                        "place": row.place,
                        "doc_id": pd.array(row.doc_ids, dtype="Int64"),
                        "inside": starts,
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    shards = spark.read.parquet(folder)
    within = W.partitionBy("part").orderBy("place")
    sizes = shards.select("part", "place", "n_ids").withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids"))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("base"))
    at = sizes.join(parts, "part").select("part", "place", (F.col("base") + F.col("before")).alias("at"))
    rows = shards.select("part", "place", "doc_ids", "doc_lengths", "matrix").mapInPandas(
        decode, "part int, place long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    rows = rows.join(at, ["part", "place"])
    return rows.select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encoded_documents(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` in the file format, in the shared folder, and read the files back.

    Null text counts as empty: its ids are the end id alone. Null ids come first; repeated rows each have
    their own ids. Extra columns are ignored. Empty input gives no rows."""
    import uuid

    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_shards(docs, folder, vocabulary, end_id)
    return stored(read_shards(spark, folder))
