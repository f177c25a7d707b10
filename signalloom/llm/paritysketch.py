"""Near-duplicate documents by an n-gram Jaccard join over parity sketches (dealt operator 7).

A document's shingles are hashed into the parts of a bit sketch; each shingle flips one bit of one part. Two sets
that differ in ``d`` shingles have sketches that differ in at most ``d`` bits, so the Hamming distance bounds the
symmetric difference from below, and with more than ``d`` parts some part is equal. Sizes of similar sets differ by
a bounded ratio, so sketches are laid out, and joined, per size band.

How many parts suffice. Similar sets of ``s`` and ``t`` shingles differ in at most ``d(s, t)`` of them, a share of
``(den - num) / (den + num)`` of ``s + t`` for the least similarity ``num / den``. The larger set's band decides the layout: it
has ``d(largest, largest) + 1 + spare`` parts, and a set joins on the first ``d(s, its largest partner) + 1 + spare`` ones; of those
that both sides have, at least ``1 + spare`` are equal. An empty part is equal by chance and gives no key. A set with at most
``spare`` empty parts still has an equal part that is not empty. Where all equal parts may be empty, both sides have
more empty ones than that, and such sets join on their first shingles in hash order as well: similar sets share
one of the first ``s - ceil(s * num / den) + 1``.

Sets, not documents, are joined: documents of one shingle set are one node. The sets of an equal part are compared by
whole sketches, in blocks of bounded size whose pairs are rows of Spark; only pairs of different components that may be
similar come back, at first a forest of them, at last all. Every link between components is thus found and verified
on the shingles; pairs inside a component are not formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.components import connected
from signalloom.llm.spread import spread_join
from signalloom.llm.store import stored

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Lists of documents up to this many rows (two longs each) are broadcast; longer ones are joined by shuffle.
SMALL = 250_000
#: Parts beyond those that similar sets need, as a share of these: so many may be empty.
SPARE = 0.2
#: One in so many groups takes part in the first round of forests.
FEW = 16
#: Sets of a block; two blocks are compared in a task at a time.
BLOCK = 1024


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    values = (values ^ (values >> np.uint64(29))) * MIX
    return values ^ (values >> np.uint64(32))


SIZED = "doc_id long, digest long, n_shingles long, set_id long, sketch binary"


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str, size: int, known: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles: ``size`` consecutive words, or all words if fewer. Words are
    runs without ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    value = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        value = _mixed(value ^ hashes[k : k + len(value)])
    return np.unique(value)


def band_starts(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands; a band spans the ratio by which similar sizes can differ."""
    starts = [1]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * den // num)))
    return np.array(starts, np.int64)


def part_keys(shingles: np.ndarray, num: int, den: int, starts: np.ndarray) -> np.ndarray:
    """64-bit keys of the parts a set joins on: in its own band and, if a larger partner can be there, the next."""
    size = len(shingles)
    if size * (den - num) < num:  # only equal sets are similar
        return np.zeros(0, np.uint64)

    def differ(s: int, t: int) -> int:
        return (s + t) * (den - num) // (den + num)

    band = int(np.searchsorted(starts, size, side="right")) - 1
    partner = size * den // num
    bands = [band, band + 1] if partner >= int(starts[band + 1]) else [band]
    place = _mixed(shingles)
    out = []
    for b in bands:
        largest = int(starts[b + 1]) - 1
        base = differ(largest, largest) + 1
        spare = int(np.ceil(SPARE * base))
        used = differ(size, min(partner, largest)) + 1 + spare
        part = ((place >> np.uint64(24)) % np.uint64(base + spare)).astype(np.int64)
        mine = np.argsort(part, kind="stable")
        mine = mine[: np.searchsorted(part[mine], used)]
        owner = part[mine]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        # parity of the bits that the part's shingles set
        words = np.bitwise_xor.reduceat(_mixed(place[mine] + MIX), first) if len(owner) else place[:0]
        where = owner[first].astype(np.uint64)
        tag = _mixed(np.uint64([b + 1]))
        out.append(_mixed(_mixed(words + tag) ^ (where * np.uint64(0xD6E8FEB86659FD93))))
        if used - len(first) > spare:
            prefix = np.partition(place, size - -(-size * num // den))[: size - -(-size * num // den) + 1]
            out.append(_mixed(_mixed(prefix ^ MIX) ^ tag))
    return np.concatenate(out)


def _set_id(shingles: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of its sorted shingle hashes."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def folded_sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch in one run of bits, the next power of two above twice the set's size (64 at least), so that
    it fills a bounded share of a text's memory. A sketch folds onto a shorter one by exclusive or of its halves."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    odd = np.bincount((_mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded_to(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, each folded to ``size`` bytes."""
    rows = np.empty((len(sketches), size // 8), np.uint64)
    for i, sketch in enumerate(sketches):
        words = np.frombuffer(sketch, "<u8")
        while len(words) > size // 8:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        rows[i] = words
    return rows


def close_pairs(sets: np.ndarray, sizes: np.ndarray, owners: np.ndarray, sketches: list[bytes], num: int, den: int, forest: bool) -> list[tuple[int, int]]:
    """Pairs of one group in different components (``owners``) whose sketches do not rule out that they are similar.
    With ``forest``, a pair also joins its two components for the rest of the group, so there are fewer pairs than
    components, and a group of copies is done after a few of its members."""
    words = folded_to(sketches, min(map(len, sketches)))
    owners = np.unique(owners, return_inverse=True)[1]
    out = []
    for i in range(len(sets) - 1):
        # later members only, unless they may have been joined to others by a forest
        rest = np.flatnonzero(owners[i + 1 :] != owners[i]) + i + 1
        if not len(rest):
            if forest and (owners == owners[0]).all():
                break
            continue
        total = sizes[rest] + sizes[i]
        likely = (den * np.minimum(sizes[rest], sizes[i])) >= num * np.maximum(sizes[rest], sizes[i])
        rest, total = rest[likely], total[likely]
        distance = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype=np.int64)
        rest = rest[distance <= total * (den - num) // (den + num)]
        if forest:
            rest = rest[np.unique(owners[rest], return_index=True)[1]]
            for j in rest:
                owners[owners == owners[j]] = owners[i]
        out += [(int(sets[i]), int(sets[j])) for j in rest]
    return out


def _linked(close: DataFrame, sets: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b: sets) that are similar by their whole shingle sets, each read from one document."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets_ = [shingle_hashes(t, size, known) for t in batch.text]
            yield pd.DataFrame({"set_id": [_set_id(s) for s in sets_], "shingles": [s.tobytes() for s in sets_]})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.x, batch.y, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    def side(table: DataFrame, column: str, *values: tuple[str, str]) -> DataFrame:
        return table.select(F.col("set_id").alias(column), *[F.col(v).alias(n) for v, n in values])

    wanted = close.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    readers = stored(wanted.join(sets, "set_id").select(F.col("reader").alias("doc_id"), "digest"))
    small = readers.count() <= SMALL
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    texts = texts.join(F.broadcast(readers) if small else readers, ["doc_id", "digest"], "left_semi").select("text")
    arrays = stored(texts.mapInPandas(shingles, "set_id long, shingles binary").dropDuplicates(["set_id"]))
    rows = close.join(side(arrays, "a", ("shingles", "x")), "a").join(side(arrays, "b", ("shingles", "y")), "b")
    return stored(rows.select("a", "b", "x", "y").mapInPandas(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles (size of its set) and component_id, the smallest doc_id that
    links reach. Two documents link when ``den`` times the shared shingles are at least ``num`` times all of both.

    Null and blank texts have no shingles and link with nothing: their component is their own id. Equal sets link.
    Rows of one id are one document with all their links, each with its own n_shingles; rows without id never link
    others and have no component. Extra columns are ignored; empty input gives no rows. Sets and shingles are told
    apart by 64-bit hashes."""
    starts = band_starts(num, den)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, shingle, known) for t in batch.text]
            yield pd.DataFrame(
                {
                    "doc_id": batch.doc_id.astype("Int64"),
                    "digest": batch.digest,
                    "n_shingles": [len(s) for s in sets],
                    "set_id": pd.array([_set_id(s) if len(s) else None for s in sets], dtype="Int64"),
                    "sketch": [folded_sketch(s) for s in sets],
                }
            )

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            seen, keys, owners, sizes = set(), [], [], []
            for text in batch.text:
                found = shingle_hashes(text, shingle, known)
                name = _set_id(found)
                if len(found) and name not in seen:
                    seen.add(name)
                    own = part_keys(found, num, den, starts)
                    keys.append(own)
                    owners.append(np.full(len(own), name, np.int64))
                    sizes.append(np.full(len(own), len(found), np.int64))
            if keys:
                yield pd.DataFrame(
                    {"part_key": np.concatenate(keys).view(np.int64), "set_id": np.concatenate(owners), "n": np.concatenate(sizes)}
                )

    base = stored(docs.withColumn("digest", F.xxhash64("text")).mapInPandas(sized, SIZED))
    sets = base.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "digest", "n_shingles", "sketch")).alias("first")
    )
    first = {"doc_id": "reader", "digest": "digest", "n_shingles": "n", "sketch": "sketch"}
    sets = stored(sets.select("set_id", *[F.col(f"first.{c}").alias(name) for c, name in first.items()]))

    # groups of two sets or more on a part: (key, set) in order, so a group streams through its task
    parts = docs.where("doc_id is not null").select("text").mapInPandas(keyed, "part_key long, set_id long, n long")
    groups = stored(different(stored(grouped(parts))))
    # documents of one id are one: their sets are linked
    own = base.where("doc_id is not null and set_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"))
    several = own.where("a <> b").select("doc_id", "a")
    links = stored(base.where("set_id is not null").join(several, "doc_id").select("a", F.col("set_id").alias("b")).where("a <> b").distinct())
    tried = links
    # two rounds of forests join most of each group of copies: near copies share most of their parts, so a share of all
    # groups does at first; the last round takes all groups and leaves out no close pair
    few = groups.where(F.pmod(F.xxhash64("part_key"), F.lit(FEW)) == 0)
    for some, forest in ((few, True), (groups, True), (groups, False)):
        close = stored(_close(some, sets, connected(links), num, den, forest).join(tried, ["a", "b"], "left_anti"))
        found = _linked(close, sets, docs, shingle, num, den)
        tried, links = stored(tried.union(close)), stored(links.union(found))
    components = connected(links)

    named = sets.join(components.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.select("set_id", "reader", F.coalesce("component", "set_id").alias("component"))
    named = stored(named)
    lowest = stored(named.groupBy("component").agg(F.min("reader").alias("component_id")))
    of_set = stored(spread_join(named, lowest, "component").select("set_id", "component_id"))
    rows = spread_join(base, of_set, "set_id")
    alone = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def _close(groups: DataFrame, sets: DataFrame, components: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Distinct close pairs (a < b) of all groups that several components meet in.

    A group's sets are dealt into blocks of about ``BLOCK``; a pair of blocks, or a block with itself, is compared by one
    task if several components meet in it. With ``forest``, blocks meet themselves and the first block alone."""

    def pairs_of(unit: pd.DataFrame) -> list[tuple[int, int]]:
        unit = unit.sort_values("set_id")
        return close_pairs(unit.set_id.to_numpy(), unit.n.to_numpy(), unit.component.to_numpy(), unit.sketch.tolist(), num, den, forest)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            # the last unit, of at most about two blocks, may go on in the next batch
            rest = rows[(rows[key] == rows[key].iloc[-1]).all(axis=1)]
            found = [p for _, g in rows[: len(rows) - len(rest)].groupby(key, sort=False) for p in pairs_of(g)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64").drop_duplicates()
        if rest is not None:
            yield pd.DataFrame(pairs_of(rest), columns=["a", "b"], dtype="int64")

    key = ["part_key", "low_block", "high_block"]
    named = groups.join(components.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id"))
    mixed = named.groupBy("part_key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high")
    named = named.join(mixed.select("part_key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "part_key")
    named = named.withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks"))
    small = named.where("blocks = 1").withColumn("low_block", F.col("block")).withColumn("high_block", F.col("block"))
    many = stored(named.where("blocks > 1"))
    blocks = many.groupBy("part_key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = (blocks.select("part_key", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "low", "high")]) for side in "xy")
    units = x.join(y, "part_key").where("x_block <= y_block and least(x_low, y_low) <> greatest(x_high, y_high)")
    if forest:
        units = units.where("x_block = y_block or x_block = 0")
    units = units.select("part_key", F.col("x_block").alias("low_block"), F.col("y_block").alias("high_block"))
    sides = units.withColumn("block", F.explode(F.array_distinct(F.array("low_block", "high_block"))))
    named = small.unionByName(many.join(sides, ["part_key", "block"]))
    named = named.join(sets.select("set_id", "sketch"), "set_id")
    named = named.repartition(*key).sortWithinPartitions(*key)
    return named.select(*key, "set_id", "n", "component", "sketch").mapInPandas(compare, "a long, b long").distinct()


def different(groups: DataFrame) -> DataFrame:
    """One of all groups with the same members, told apart by two 64-bit sums of hashes and their number."""
    members = groups.groupBy("part_key").agg(
        F.expr("bit_xor(xxhash64(set_id))").alias("x"), F.expr("bit_xor(xxhash64(set_id, 1))").alias("y"), F.count("*").alias("m")
    )
    kept = members.groupBy("x", "y", "m").agg(F.min("part_key").alias("part_key")).select("part_key")
    return groups.join(kept, "part_key", "left_semi")


def grouped(parts: DataFrame) -> DataFrame:
    """part_key, set_id, n of every key that two sets or more have."""
    from pyspark.sql import Window as W

    order = W.partitionBy("part_key").orderBy("set_id")
    rows = parts.withColumn("hub", F.first("set_id").over(order)).withColumn("next", F.lead("set_id").over(order))
    # repeats of a set are neighbours: the last one stands for it; a first set that nothing follows is alone
    rows = rows.where("(next is null or next <> set_id) and (hub <> set_id or next is not null)")
    return rows.select("part_key", "set_id", "n")
