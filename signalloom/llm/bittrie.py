"""SimHash near-duplicates by a self-join of binary tries (dealt operator 13).

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it. Distinct fingerprints are
joined with themselves by walking a binary trie in pairs of nodes: a pair of nodes has the number of bits in which their
paths differ, its children are the pairs of their children, and a pair with more errors than the budget is dropped.

Where the walk starts. Of ``budget + equal`` blocks of bits, a linked pair has ``equal`` blocks without an error. So there
is one trie for each choice of ``equal`` blocks, with the bits of these first, and the walk of a trie starts from each
node below them, paired with itself. More fingerprints take more equal blocks, so that such a node stays small whatever
the size of the input.

How it is shared out. A start with at most ``capacity`` fingerprints is walked by one task. Larger ones are walked down in
Spark by ``STEP`` bits a round, as rows of node pairs, until the nodes of a pair are small; each such pair then goes to a
task. Nodes are paired with themselves first, and what links there merges into components; pairs of nodes whose
fingerprints are all of one component are dropped before the rest is walked, in Spark and in the tasks alike, so that
a large group of near copies does not cost the square of its size. Every link between components is found and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.components import connected
from signalloom.llm.spread import spread_join
from signalloom.llm.store import stored

BITS = 64
#: Bits by which nodes that are too large for a task are divided in a round.
STEP = 4
#: Node pairs with at most so many fingerprint pairs are compared outright.
LEAF = 64
#: Node pairs that a task divides at once.
SLICE = 1 << 15


def fingerprint(text: str | None, size: int) -> int:
    """Unsigned fingerprint of a text: bits set in over half the hashes of its shingles of ``size`` words, repeats
    included (all words if fewer, zero if none). Words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), "<u8", len(starts)
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def trie_orders(budget: int, equal: int) -> tuple[list[np.ndarray], list[int]]:
    """Orders of the blocks (first bit, bits) in the tries, one for each choice of ``equal`` blocks, which come first, and
    the number of bits in these."""
    blocks = np.array([(b[0], len(b)) for b in np.array_split(np.arange(BITS), budget + equal)])
    chosen = [list(c) for c in combinations(range(budget + equal), equal)]
    return [np.concatenate([blocks[c], np.delete(blocks, c, axis=0)]) for c in chosen], [int(blocks[c, 1].sum()) for c in chosen]


def reordered(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values with their blocks of bits moved: the first in ``order`` to the top, and so on."""
    out, at = np.zeros(len(values), np.uint64), BITS
    for begin, size in order.tolist():
        at -= size
        out |= ((values >> np.uint64(begin)) & np.uint64((1 << size) - 1)) << np.uint64(at)
    return out


def walk(values: np.ndarray, owners: np.ndarray, left: np.ndarray, right: np.ndarray, depth: np.ndarray, errors: np.ndarray, budget: int) -> np.ndarray:
    """Lowest owner that each owner reaches by pairs of ``values`` within the budget, from pairs of nodes of a trie.

    A node is a range of positions, sorted by value within it; ``left`` and ``right`` hold ranges (begin, end), ``depth``
    the lengths of their paths and ``errors`` the bits in which these differ. ``owners`` are numbers from 0; pairs
    of one owner are no news."""
    low = np.arange(owners.max(initial=-1) + 1)
    stack = [(left, right, depth, errors)]
    while stack:
        left, right, depth, errors = stack.pop()
        if len(left) > SLICE:
            stack += [tuple(x[SLICE:] for x in (left, right, depth, errors))]
            left, right, depth, errors = (x[:SLICE] for x in (left, right, depth, errors))
        # nodes that are of one component by now
        of = low[owners]
        changes = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
        one = [changes[side[:, 1] - 1] == changes[side[:, 0]] for side in (left, right)]
        open_ = ~(one[0] & one[1] & (of[left[:, 0]] == of[right[:, 0]]))
        left, right, depth, errors = (x[open_] for x in (left, right, depth, errors))
        small = ((left[:, 1] - left[:, 0]) * (right[:, 1] - right[:, 0]) <= LEAF) | (depth >= BITS)
        if small.any():
            i, j = _compare(values, left[small], right[small], budget)
            _merge(low, owners[i], owners[j])
            left, right, depth, errors = (x[~small] for x in (left, right, depth, errors))
        if not len(left):
            continue
        # down by one bit: the children of a node lie before and after its middle
        bit = np.uint64(1) << (BITS - 1 - depth).astype(np.uint64)
        middle = [_middle(values, side, bit) for side in (left, right)]
        same = left[:, 0] == right[:, 0]
        parts = []
        for a, b in ((0, 0), (1, 1), (0, 1), (1, 0)):
            x = np.stack([middle[0], left[:, 1]] if a else [left[:, 0], middle[0]], axis=1)
            y = np.stack([middle[1], right[:, 1]] if b else [right[:, 0], middle[1]], axis=1)
            kept = (x[:, 1] > x[:, 0]) & (y[:, 1] > y[:, 0]) & (errors + (a != b) <= budget)
            if a > b:
                kept &= ~same  # (0, 1) has these pairs
            parts.append((x[kept], y[kept], depth[kept] + 1, errors[kept] + (a != b)))
        stack.append(tuple(np.concatenate(p) for p in zip(*parts, strict=True)))
    return low


def _middle(values: np.ndarray, nodes: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First position of each node whose value has the bit, by bisection of all nodes together."""
    low, high = nodes[:, 0].copy(), nodes[:, 1].copy()
    while (within := low < high).any():
        mid = (low + high) // 2
        has = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        high = np.where(within & has, mid, high)
        low = np.where(within & ~has, mid + 1, low)
    return low


def _compare(values: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of small node pairs that are within the budget."""
    m = right[:, 1] - right[:, 0]
    size = (left[:, 1] - left[:, 0]) * m
    pair = np.repeat(np.arange(len(left)), size)
    inner = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i, j = left[pair, 0] + inner // m[pair], right[pair, 0] + inner % m[pair]
    near = np.bitwise_count(values[i] ^ values[j]) <= budget
    return i[near], j[near]


def _merge(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j, in place: the higher root hangs below the lower one until no pair is open."""
    while len(i):
        a, b = low[i], low[j]
        apart = a != b
        i, j = i[apart], j[apart]
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while ((up := low[low]) != low).any():
            low[:] = up


def _walked(rows: DataFrame, budget: int, capacity: int) -> DataFrame:
    """Links (a, b) between owners of the node pairs in ``rows`` (trie, x, y, depth, errors, side, path, fingerprint,
    owner): side 0 has the fingerprints of x, side 1 those of y; a node paired with itself has side 0 alone."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(path=group.path.to_numpy(np.int64).view(np.uint64))
        group = group.sort_values(["trie", "x", "y", "side", "path"], kind="stable", ignore_index=True)
        keys = group[["trie", "x", "y", "side"]].to_numpy(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ranges = np.stack([cut, np.append(cut[1:], len(group))], axis=1)
        first = keys[cut, 3] == 0
        left, right = ranges[first], ranges[first].copy()
        right[keys[cut[first], 1] != keys[cut[first], 2]] = ranges[~first]
        names, owners = np.unique(group.owner.to_numpy(np.int64), return_inverse=True)
        at = cut[first]
        low = walk(group.path.to_numpy(), owners, left, right, group.depth.to_numpy(np.int64)[at], group.errors.to_numpy(np.int64)[at], budget)
        moved = np.flatnonzero(low != np.arange(len(low)))
        return pd.DataFrame({"a": names[moved], "b": names[low[moved]]})

    buckets = rows.count() // capacity + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("trie", "x", "y"), F.lit(buckets)))
    return stored(rows.groupBy("bucket").applyInPandas(links, "a long, b long").distinct())


def _own(rows: DataFrame) -> DataFrame:
    """Nodes paired with themselves."""
    return rows.select("trie", F.col("node").alias("x"), F.col("node").alias("y"), "depth", F.lit(0).alias("errors"), F.lit(0).alias("side"), "path", "owner")


def _level(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with their node after ``k`` steps down from their start, and its parent."""

    def prefix(depth: Column) -> Column:
        return F.when(depth >= BITS, F.col("path")).otherwise(F.call_function("shiftrightunsigned", "path", BITS - depth))

    depths = [F.least(F.col("depth") + STEP * i, F.lit(BITS)) for i in (k - 1, k)]
    return rows.withColumn("parent", prefix(depths[0])).withColumn("node", prefix(depths[1])).withColumn("depth", depths[1])


def links_within(fingerprints: DataFrame, budget: int = 4, equal: int | None = None, capacity: int = 1 << 13) -> DataFrame:
    """Links (a, b) that put any two distinct ``fingerprints`` (fingerprint: long) that differ in at most ``budget`` bits
    into one component, and no others. ``equal`` blocks head a trie; by default as many as keep the starting
    nodes of evenly spread fingerprints below 2,048. A task holds about ``capacity`` fingerprints at a time."""
    if equal is None:
        n, equal = fingerprints.count(), 1
        while equal < 3 and n >> (BITS * equal // (budget + equal)) > 2048:
            equal += 1
    orders, heads = trie_orders(budget, equal)

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every fingerprint in each trie, with its starting node."""
        for batch in batches:
            values = batch.fingerprint.to_numpy(np.int64).view(np.uint64)
            for trie, (order, head) in enumerate(zip(orders, heads, strict=True)):
                path = reordered(values, order)
                node = (path >> np.uint64(BITS - head)).view(np.int64)
                yield pd.DataFrame({"trie": trie, "node": node, "depth": head, "path": path.view(np.int64), "owner": batch.fingerprint})

    rows = stored(fingerprints.select("fingerprint").mapInPandas(paths, "trie int, node long, depth int, path long, owner long"))
    starts = stored(rows.groupBy("trie", "node").agg(F.count("*").alias("n")).where("n > 1"))
    small = rows.join(starts.where(F.col("n") <= capacity).select("trie", "node"), ["trie", "node"], "left_semi")
    links = _walked(stored(_own(small)), budget, capacity)
    large = stored(starts.where(F.col("n") > capacity).select("trie", "node"))
    if large.isEmpty():
        return links

    # nodes too large for a task, paired with themselves: further down, until they are small
    deep = stored(rows.join(large, ["trie", "node"], "left_semi"))
    found, open_, k = [links], large, 0
    while not open_.isEmpty():
        k += 1
        level = _level(deep, k).join(open_.withColumnRenamed("node", "parent"), ["trie", "parent"], "left_semi")
        nodes = stored(level.groupBy("trie", "node").agg(F.count("*").alias("n")))
        ready = nodes.where(F.col("n") <= capacity).select("trie", "node")
        found.append(_walked(stored(_own(level.join(ready, ["trie", "node"], "left_semi"))), budget, capacity))
        open_ = nodes.where(F.col("n") > capacity).select("trie", "node")

    # pairs of different nodes, down the same way, unless all below them is one component
    named = connected(reduce(DataFrame.union, found)).select(F.col("node").alias("owner"), "component")
    deep = stored(deep.join(named, "owner", "left").withColumn("owner", F.coalesce("component", "owner")).drop("component"))
    pairs, k = large.select("trie", F.col("node").alias("x"), F.col("node").alias("y")), 0
    while not pairs.isEmpty():
        k += 1
        level = _level(deep, k)
        nodes = stored(level.groupBy("trie", "parent", "node").agg(F.count("*").alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")))
        x, y = (nodes.select("trie", F.col("parent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "low", "high")]) for s in "xy")
        pairs = pairs.join(x, ["trie", "x"]).join(y, ["trie", "y"])
        pairs = pairs.where("(x <> y or x_node <= y_node) and not (x_low = x_high and y_low = y_high and x_low = y_low)")
        pairs = pairs.withColumn("errors", F.bit_count(F.col("x_node").bitwiseXOR(F.col("y_node")))).where(F.col("errors") <= budget)
        small = (F.col("x_n") <= capacity) & (F.col("y_n") <= capacity)
        pairs = stored(pairs.select("trie", F.col("x_node").alias("x"), F.col("y_node").alias("y"), "errors", small.alias("small")))
        ready = pairs.where("small and x <> y").drop("small")
        sides = [
            ready.join(level.select("trie", F.col("node").alias(s), "depth", "path", "owner"), ["trie", s]).withColumn("side", F.lit(i))
            for i, s in enumerate("xy")
        ]
        found.append(_walked(stored(sides[0].unionByName(sides[1])), budget, capacity))
        pairs = pairs.where("not small").select("trie", "x", "y")
    return stored(reduce(DataFrame.union, found).distinct())


def simhash_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, capacity: int = 1 << 13) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprint (16 hex digits) and component_id, the smallest doc_id that links
    reach. Two documents link when their fingerprints differ in at most ``budget`` bits.

    Null and blank texts have the fingerprint zero and link like any other. Rows of one id are one document with the
    links of all their texts, each with its own fingerprint; rows without id have a fingerprint, but link nothing and
    have no component. Extra columns are ignored; empty input gives no rows."""

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.text], np.uint64)
            yield pd.DataFrame({"doc_id": batch.doc_id, "fingerprint": found.view(np.int64)})

    # ids pass through pandas as text: whole numbers next to nulls would become doubles there
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(prints, "doc_id string, fingerprint long")
    rows = stored(rows.withColumn("doc_id", F.col("doc_id").cast("long")))
    known = rows.where("doc_id is not null")
    first = stored(known.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    links = links_within(first.select("fingerprint"), budget, capacity=capacity)
    several = stored(known.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("doc_id", "a"))
    if not several.isEmpty():
        links = links.union(known.join(several, "doc_id").select("a", F.col("fingerprint").alias("b")).where("a <> b"))
    of = connected(links).withColumnRenamed("node", "fingerprint")
    named = stored(first.join(of, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")))
    lowest = stored(named.groupBy("component").agg(F.min("first").alias("component_id")))
    of = spread_join(named.select("fingerprint", "component"), lowest, "component").select("fingerprint", "component_id")
    rows = spread_join(rows, stored(of), "fingerprint")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
