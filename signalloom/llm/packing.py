"""Packing documents into fixed-length training sequences (dealt operator 1).

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups of
documents: a document is cut into full sequences and one remainder; remainders of a group are placed, longest
first, into the first open sequence with room, found in ``log2`` steps from the root of a tree whose inner
nodes hold the largest free capacity below them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.store import stored
from signalloom.llm.tokens import ByteLevelIds

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, padded_length long"
)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bunch long"
#: Sequence ids are the group's number times this plus the sequence's place in the group.
PER_GROUP = 1 << 40


class FirstFit:
    """Bins of one capacity. ``place`` returns the first bin with room for ``length``, opening one if none has."""

    def __init__(self, capacity: int, expected: int) -> None:
        self.capacity = capacity
        self.leaves = 1 << max(0, expected - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.opened = 0

    def _grow(self) -> None:
        old, n = self.tree[self.leaves :], self.leaves * 2
        self.leaves = n
        self.tree = [self.capacity] * n + old + [self.capacity] * (n - len(old))
        for node in range(n - 1, 0, -1):
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it. Unopened bins are whole, so the leftmost fit is the first fit."""
        if self.tree[1] < length:
            self._grow()
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        offset = self.capacity - tree[node]
        tree[node] -= length
        found = node - self.leaves
        self.opened = max(self.opened, found + 1)
        node //= 2
        while node:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
            node //= 2
        return found, offset


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, none above ``capacity``; placed in decreasing order, ties as given."""
    bins = FirstFit(capacity, sum(lengths) // capacity + 1)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = bins.place(lengths[i])
    return out


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, groups: int, seed: int) -> DataFrame:
    """One row per piece: full sequences from the front of a document, then its remainder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ByteLevelIds(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text, bunch in zip(batch.doc_id, batch.text, batch.bunch, strict=True):
                ids = encoder.encode(text) + end_id.to_bytes(4, "little")
                for start in range(0, len(ids), 4 * capacity):
                    piece = ids[start : start + 4 * capacity]
                    rows.append((doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, bunch))
            table = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bunch"])
            table["doc_id"] = table["doc_id"].astype("Int64")
            yield table

    text = F.coalesce(F.col("text"), F.lit(""))
    bunch = F.pmod(F.xxhash64(F.lit(seed), "doc_id", text, F.spark_partition_id()), F.lit(groups))
    return docs.select("doc_id", text.alias("text"), bunch.alias("bunch")).mapInPandas(cut, PIECES)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 1,
    group_size: int = 8192,
    seed: int = 17,
) -> DataFrame:
    """Every token of ``docs`` (doc_id, text) in exactly one piece of one sequence of at most ``capacity``.

    Groups hold about ``group_size`` documents, chosen by a hash of the row, so no source or group of copies
    makes a group large; a task holds piece numbers of one group, never its texts. Sequences start at
    offset 0 without gaps. ``padded_length`` is the length a sequence is padded to: ``capacity``, or its own
    length if that is a power of two.

    Null text counts as empty: its document is the end id alone. Repeated rows are documents of their own.
    Null ids stay null. Extra columns are ignored. Empty input gives no rows.
    """
    groups = max(1, -(-docs.count() // group_size))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        length = group["length"].to_numpy()
        full = length == capacity
        sequence = np.empty(len(group), np.int64)
        offset = np.zeros(len(group), np.int64)
        sequence[full] = np.arange(full.sum())
        rest = np.flatnonzero(~full)
        places = pack_group(length[rest].tolist(), capacity)
        sequence[rest] = [full.sum() + p[0] for p in places]
        offset[rest] = [p[1] for p in places]
        used = np.bincount(sequence, weights=length).astype(np.int64) if len(group) else np.zeros(0, np.int64)
        padded = np.where(used & (used - 1) == 0, used, capacity)
        group["sequence_id"] = int(key[0]) * PER_GROUP + sequence
        group["offset"] = offset
        group["padded_length"] = padded[sequence]
        return group.drop(columns="bunch")

    pieces = stored(tokenized_pieces(docs, vocabulary, capacity, end_id, groups, seed))
    return pieces.groupBy("bunch").applyInPandas(pack, SCHEMA)
