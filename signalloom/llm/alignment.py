"""Alignment of two tokenizers' tokens over the same bytes (dealt operator 11).

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Where the tokens of both sides spell the
same bytes, every token has a byte range on one line. ``pandas.merge_asof``, keyed by document, finds for each token
start the other side's token that covers it; both directions together give all overlapping pairs, since of two
overlapping tokens the one that starts later starts inside the other. Ends that both sides share cut groups.

How many documents hold a pair linked is counted per batch first: a batch, bounded in bytes, has a dictionary of its
pairs. Only dictionaries are shuffled: a pair comes once per batch, however many documents hold it. Counts go
back to the batches by dictionary position, next to the batch's links.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalloom.llm.store import stored
from signalloom.llm.tokens import BYTE_LEVEL, LETTERS, unsafe

#: Text bytes of a batch; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: The space in a piece vocabulary.
SPACE = "\u2581"


class Encoders:
    """Ids of whole texts by both vocabularies, as little-endian unsigned 32-bit integers.

    A text of safe characters whose white space is blanks and line breaks is cut before each run of these: no
    pre-token of A starts inside a run and ends behind the next word, and no piece of B holds a blank after another
    character or a line break, so chunks are encoded one by one and remembered. Other texts go to the libraries whole."""

    def __init__(self, path_a: str, path_b: str, cache_size: int = 120_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {letter: value for value, letter in LETTERS.items()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.a_bytes[number] = bytes(map(letters.__getitem__, entry)) if all(x in letters for x in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.space = pieces.index(SPACE) if SPACE in pieces else None
        # a library that keeps every safe character spells safe texts; both merge bytes or pieces and drop nothing
        safe = "".join(chr(c) for c in range(0x250) if not unsafe(chr(c)))
        kept = all(self._whole(" " + t, *self._ids(t)) for t in ["  a\n b  ", safe, *safe])
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in pieces)
        self.by_chunk = kept and not crossing and self.space is not None
        self.byte_level, self.pattern = regex.compile(BYTE_LEVEL), re.compile(r"[ \n]+[^ \n]*")
        self.size, self.chunks, self.old = cache_size, {}, {}

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)

    def _whole(self, line: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides spell the line."""
        spelled = line.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a)) == spelled == b"".join(map(self.b_bytes.__getitem__, b))

    def _remember(self, chunks: set[str]) -> None:
        """Put all of them into the cache, which keeps two generations: what is asked for again stays."""
        if len(self.chunks) > self.size:
            self.old, self.chunks = self.chunks, {}
        new = []
        for chunk in chunks:
            if chunk not in self.chunks:
                if chunk in self.old:
                    self.chunks[chunk] = self.old[chunk]
                else:
                    new.append(chunk)
        # B's library puts a blank in front of all it gets
        found = self.b.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1)
        for chunk, b in zip(new, found, strict=True):
            words = [chunk] if chunk[0] == " " and chunk[1:].isalpha() else self.byte_level.findall(chunk)
            a = [token.id for word in words for token in self.a.model.tokenize(word.encode().decode("latin-1").translate(LETTERS))]
            b = [self.space] if chunk == " " else b if chunk[0] == " " else b[1:]
            self.chunks[chunk] = struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of A for a blank and the text, of B for the text, or none if the text is empty or a side spells it differently."""
        cut = [self.by_chunk and bool(t) and not ("\t" in t or "\r" in t or unsafe(t)) for t in texts]
        chunks = [self.pattern.findall(" " + t) if c else [] for t, c in zip(texts, cut, strict=True)]
        self._remember(set().union(*chunks))
        out = []
        for text, own in zip(texts, chunks, strict=True):
            if own:
                pairs = list(map(self.chunks.__getitem__, own))
                out.append((b"".join([x for x, _ in pairs]), b"".join([x for _, x in pairs])))
                continue
            a, b = self._ids(text) if text else ([], [])
            kept = bool(text) and self._whole(" " + text, a, b)
            out.append((struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b)) if kept else (b"", b""))
        return out


@dataclass
class Aligned:
    """Tokens of some documents on one line of bytes. ``a`` and ``b`` hold ids, ``a_doc`` and ``b_doc`` document numbers;
    link ``i`` joins tokens ``left[i]`` and ``right[i]``; ``a_group`` and ``b_group`` number the groups of all documents."""

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    left: np.ndarray
    right: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


class Aligner:
    """The alignment of batches of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.encoders = Encoders(path_a, path_b)
        self.sizes = [np.array(list(map(len, table)), np.int64) for table in (self.encoders.a_bytes, self.encoders.b_bytes)]
        # decimal ids with what follows them in the digest: within a group, before B's tokens, before the next group, at the end
        self.most = max(map(len, self.sizes))
        self.digits = [str(i).encode() + mark for mark in (b",", b"|", b";", b"") for i in range(self.most)]

    def align(self, texts: list[str | None]) -> Aligned:
        sides = [[np.frombuffer(side, "<u4") for side in pair] for pair in self.encoders.encode(texts)]
        ids, docs, starts, ends = [], [], [], []
        for side in (0, 1):
            ids.append(np.concatenate([s[side] for s in sides]).astype(np.int64) if sides else np.zeros(0, np.int64))
            docs.append(np.repeat(np.arange(len(sides)), [len(s[side]) for s in sides]))
            ends.append(np.cumsum(self.sizes[side][ids[side]]))
            starts.append(ends[side] - self.sizes[side][ids[side]])
        a, b = (pd.DataFrame({"doc": docs[s], "start": starts[s], "token": np.arange(len(ids[s]))}) for s in (0, 1))
        # each start, and the token of the other side that covers it; equal starts are found from both sides
        over = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
        under = pd.merge_asof(b, a, on="start", by="doc", suffixes=("_b", "_a"))
        under = under[starts[0][under.token_a.to_numpy(np.int64)] != under.start.to_numpy()] if len(under) else under
        left = np.concatenate([over.token_a.to_numpy(np.int64), under.token_a.to_numpy(np.int64)])
        right = np.concatenate([over.token_b.to_numpy(np.int64), under.token_b.to_numpy(np.int64)])
        shared = np.intersect1d(*ends, assume_unique=True)
        return Aligned(*ids, *docs, left, right, *(np.searchsorted(shared, e, side="left") for e in ends))

    def group_texts(self, of: Aligned, many: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each of ``many`` documents, empty for one without tokens."""
        last = [np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool) for group in (of.a_group, of.b_group)]
        final = np.append(of.b_doc[1:] != of.b_doc[:-1], True) if len(of.b_doc) else np.zeros(0, bool)
        codes = np.empty(len(of.a) + len(of.b), np.int64)
        codes[np.arange(len(of.a)) + np.searchsorted(of.b_group, of.a_group, side="left")] = of.a + self.most * last[0]
        codes[np.arange(len(of.b)) + np.searchsorted(of.a_group, of.b_group, side="right")] = of.b + self.most * np.where(final, 3, 2 * last[1])
        pieces = list(map(self.digits.__getitem__, codes.tolist()))
        ends = np.cumsum(np.bincount(of.a_doc, minlength=many) + np.bincount(of.b_doc, minlength=many))
        return [b"".join(pieces[begin:end]) for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(maxsize=1)
def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker, so that its bounded caches outlive a task."""
    return Aligner(path_a, path_b)


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most ``BATCH_BYTES`` of text, or of one longer text."""
    for batch in batches:
        ends = np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) for t in batch.text])
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            yield batch.iloc[at:stop]
            at = stop


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): a_ids and b_ids, links (a, b: token positions from 0) whose byte ranges overlap,
    and groups (a_end, b_end: tokens up to the end of each group).

    Both sides spell a blank and the text. A text that is null, empty, or spelled differently by a side has empty lists.
    Repeated rows come as often as they occur, rows without id too; extra columns are ignored; empty input gives no rows."""
    schema = "doc_id string, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, groups array<struct<a_end:int,b_end:int>>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = worker_aligner(path_a, path_b)
        for batch in _bounded(batches):
            of, out = aligner.align(batch.text.tolist()), []
            for doc in range(len(batch)):
                (a0, a1), (b0, b1) = (np.searchsorted(d, [doc, doc + 1]).tolist() for d in (of.a_doc, of.b_doc))
                mine = (of.left >= a0) & (of.left < a1)
                links = sorted(zip((of.left[mine] - a0).tolist(), (of.right[mine] - b0).tolist(), strict=True))
                ends = [np.searchsorted(g[x:y], np.unique(g[x:y]), side="right").tolist() for g, x, y in ((of.a_group, a0, a1), (of.b_group, b0, b1))]
                groups = [{"a_end": x, "b_end": y} for x, y in zip(*ends, strict=True)]
                out.append((batch.doc_id.iloc[doc], of.a[a0:a1].tolist(), of.b[b0:b1].tolist(), [{"a": x, "b": y} for x, y in links], groups))
            yield pd.DataFrame(out, columns=["doc_id", "a_ids", "b_ids", "links", "groups"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(rows, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


COUNTED = "batch long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, holders array<long>"


def alignment_statistics(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a and n_b tokens, n_groups, n_links, n_best (links whose pair of ids is held by
    as many documents as any pair of its A id), count_sum (documents that hold the pair, over links) and groups_sha256.

    Defined as ``aligned_tokens``; a text without alignment has zeros and an empty digest. Every row counts as a document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = worker_aligner(path_a, path_b)
        part = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(_bounded(batches)):
            of, many = aligner.align(batch.text.tolist()), len(batch)
            doc = of.a_doc[of.left]
            pairs, inner = np.unique(of.a[of.left] << 32 | of.b[of.right], return_inverse=True)
            held, times = np.unique(doc * len(pairs) + inner, return_counts=True)
            owner, place = np.divmod(held, max(1, len(pairs)))
            cuts = np.searchsorted(owner, np.arange(many + 1))
            cells = np.stack([place, times], axis=1).astype("<u4")
            groups = np.bincount(of.a_doc[np.append(of.a_group[1:] != of.a_group[:-1], True)] if len(of.a) else of.a_doc, minlength=many)
            texts = aligner.group_texts(of, many)
            rows = pd.DataFrame(
                {
                    "batch": part + number,
                    "doc_id": batch.doc_id.to_numpy(),
                    "n_a": np.bincount(of.a_doc, minlength=many),
                    "n_b": np.bincount(of.b_doc, minlength=many),
                    "n_groups": groups,
                    "n_links": np.bincount(doc, minlength=many),
                    "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts],
                    "links": [cells[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
                    "pairs": None,
                    "holders": None,
                }
            )
            yield rows
            if len(pairs):
                yield pd.DataFrame({c: [None] for c in rows.columns} | {"batch": [part + number], "pairs": [pairs], "holders": [np.bincount(place)]})

    def look_up(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The links of a batch's documents, by the counts of its pairs."""
        found = found.sort_values("place")
        counts, best = found["count"].to_numpy(np.int64), found["best"].to_numpy(np.int64)
        cells = np.frombuffer(b"".join(rows.links), "<u4").reshape(-1, 2).astype(np.int64)
        ends = np.cumsum([len(x) // 8 for x in rows.links])
        sums = [np.concatenate([[0], np.cumsum(cells[:, 1] * value[cells[:, 0]])]) for value in (best, counts)]
        n_best, count_sum = (s[ends] - s[np.concatenate([[0], ends[:-1]])] for s in sums)
        return rows.drop(columns=["batch", "links"]).assign(n_best=n_best, count_sum=count_sum)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, COUNTED)
    rows = stored(rows)
    books = rows.where("pairs is not null")
    cells = books.select("batch", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "cell"))
    cells = cells.select("batch", "place", F.col("cell.pairs").alias("pair"), F.col("cell.holders").alias("holders"))
    counts = cells.groupBy("pair").agg(F.sum("holders").alias("count"))
    # an A id has at most as many pairs as B has ids
    of_a = W.partitionBy(F.expr("shiftright(pair, 32)"))
    counts = stored(counts.withColumn("best", (F.col("count") == F.max("count").over(of_a)).cast("long")))
    found = cells.drop("holders").join(counts, "pair").select(F.col("batch").alias("of_batch"), "place", "count", "best")
    own = rows.where("pairs is null").drop("pairs", "holders")
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    result = own.groupBy("batch").cogroup(found.groupBy("of_batch")).applyInPandas(look_up, schema)
    return result.withColumn("doc_id", F.col("doc_id").cast("long"))
