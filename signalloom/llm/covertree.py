"""Exact top-k inner products by dual-tree search over cover trees (dealt operator 9).

Vectors are dealt to the nearest of a bounded number of pivots, cells into blocks, and each block is indexed by a cover
tree; the queries are dealt into blocks of their own and indexed too. A task holds one tree of each kind. No product of a
query below node Q and a vector below node R exceeds ``q.r + |q| rad(R) + |r| rad(Q) + rad(Q) rad(R)`` for their centres
q, r and covering radii; a pair of nodes is dropped when that is below the worst k-th score among Q's queries. The same
holds for whole blocks: each block of queries first meets the block of the highest bound, then only those
whose bound reaches its worst k-th score so far; trees move for these pairs alone. A last step merges the blocks' best.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.llm.store import stored

#: Points of a node that is not divided further.
LEAF = 48
#: Covering radii shrink by this factor from a node to its children.
SHRINK = 1.4
#: Pivots of one length of vectors at most, in number and in components.
PIVOTS, PIVOT_COMPONENTS = 1024, 1 << 20
BLOCKS = "dim long, number long, n long, centre array<double>, radius double, tree binary"


@dataclass
class CoverTree:
    """Nodes as arrays. Node ``i`` covers ``order[begin[i]:end[i]]`` within ``radius[i]`` of point ``centre[i]``;
    its children are ``first[i]`` up to ``first[i] + width[i]`` (none for a leaf)."""

    ids: np.ndarray
    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    width: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> CoverTree:
        """Children of a node: its own centre, then centres that no earlier child covers, each with the points
        nearest in that order within the shrunken radius; so children are apart by that radius."""
        order = np.arange(len(points))
        centre, radius, begin, end, first, width = [0], [0.0], [0], [len(points)], [0], [0]
        at = 0
        while at < len(centre):
            own = order[begin[at] : end[at]]
            far = np.sqrt(((points[own] - points[centre[at]]) ** 2).sum(axis=1))
            radius[at] = float(far.max(initial=0.0))
            if len(own) > LEAF and radius[at] > 0:
                reach, left, runs, head = radius[at] / SHRINK, own, [], centre[at]
                while len(left):
                    gap = np.sqrt(((points[left] - points[head]) ** 2).sum(axis=1))
                    near = gap <= reach
                    runs.append((head, left[near]))
                    left = left[~near]
                    head = left[0] if len(left) else head
                order[begin[at] : end[at]] = np.concatenate([r for _, r in runs])
                first[at], width[at] = len(centre), len(runs)
                start = begin[at]
                for head, run in runs:
                    centre.append(head)
                    radius.append(0.0)
                    begin.append(start)
                    start += len(run)
                    end.append(start)
                    first.append(0)
                    width.append(0)
            at += 1
        return cls(ids, points, order, *(np.array(x) for x in (centre, radius, begin, end, first, width)))

    def below(self, node: int) -> np.ndarray:
        return self.order[self.begin[node] : self.end[node]]


class DualSearch:
    """The ``k`` best of ``data`` for each point of ``queries``: (score, id) by falling score, then rising id. A
    point with a query's own id does not count. Scores below ``floor`` may be left out."""

    def __init__(self, queries: CoverTree, data: CoverTree, k: int, floor: float = -np.inf) -> None:
        self.q, self.r, self.k, self.floor = queries, data, k, floor
        n = len(queries.points)
        self.scores = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.q_norm = np.sqrt((queries.points[queries.centre] ** 2).sum(axis=1))
        self.r_centre = data.points[data.centre]
        self.r_norm = np.sqrt((self.r_centre**2).sum(axis=1))

    def bounds(self, q: int, nodes: np.ndarray) -> np.ndarray:
        rad = self.q.radius[q]
        top = self.r_centre[nodes] @ self.q.points[self.q.centre[q]] + self.q_norm[q] * self.r.radius[nodes]
        top = top + rad * (self.r_norm[nodes] + self.r.radius[nodes])
        return top + 1e-9 * (np.abs(top) + 1)  # rounding never drops a pair

    def worst(self, q: int) -> float:
        return max(self.floor, float(self.scores[self.q.below(q), -1].min(initial=np.inf)))

    def run(self) -> None:
        stack = [(0, np.array([0]))] if len(self.q.points) and len(self.r.points) else []
        while stack:
            q, nodes = stack.pop()
            nodes = nodes[self.bounds(q, nodes) >= self.worst(q)]
            if not len(nodes):
                continue
            if not self.q.width[q]:
                self._group(q, nodes)
                continue
            # both trees go down together
            inner = nodes[self.r.width[nodes] > 0]
            under = [np.arange(self.r.first[i], self.r.first[i] + self.r.width[i]) for i in inner]
            nodes = np.concatenate([nodes[self.r.width[nodes] == 0], *under])
            first = self.q.first[q]
            stack += [(c, nodes) for c in range(first, first + self.q.width[q])]

    def _group(self, q: int, nodes: np.ndarray) -> None:
        """Best first for the queries of one leaf."""
        heap = [(-b, n) for b, n in zip(self.bounds(q, nodes).tolist(), nodes.tolist(), strict=True)]
        heapq.heapify(heap)
        own, worst = self.q.below(q), self.worst(q)
        while heap and -heap[0][0] >= worst:
            leaves, size = [], 0
            while heap and size < 512 and -heap[0][0] >= worst:
                _, node = heapq.heappop(heap)
                if self.r.width[node]:
                    below = np.arange(self.r.first[node], self.r.first[node] + self.r.width[node])
                    bound = self.bounds(q, below)
                    for b, n in zip(bound.tolist(), below.tolist(), strict=True):
                        if b >= worst:
                            heapq.heappush(heap, (-b, n))
                else:
                    leaves.append(node)
                    size += self.r.end[node] - self.r.begin[node]
            if leaves:
                self._leaf(own, np.concatenate([self.r.below(n) for n in leaves]))
                worst = self.worst(q)

    def _leaf(self, own: np.ndarray, points: np.ndarray) -> None:
        ids = self.r.ids[points]
        scores = self.q.points[own] @ self.r.points[points].T
        scores[self.q.ids[own][:, None] == ids[None, :]] = -np.inf
        better = (scores >= self.scores[own, -1][:, None]) & (scores > -np.inf)
        for row in np.flatnonzero(better.any(axis=1)):
            hit = np.flatnonzero(better[row])
            score = np.concatenate([self.scores[own[row]], scores[row, hit]])
            name = np.concatenate([self.found[own[row]], ids[hit]])
            best = np.lexsort((name, -score))[: self.k]
            self.scores[own[row]], self.found[own[row]] = score[best], name[best]

    def results(self) -> pd.DataFrame:
        taken = np.isfinite(self.scores)
        row = np.nonzero(taken)[0]
        return pd.DataFrame({"query_id": self.q.ids[row], "vec_id": self.found[taken], "score": self.scores[taken].astype(np.int64)})


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, vec (doubles) of the rows that take part: components floored after scaling."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, dims, out = [], [], []
            for vec_id, values in zip(batch.vec_id, batch.embedding, strict=True):
                if values is None or pd.isna(vec_id):
                    continue
                vec = np.array([np.nan if v is None else v for v in values], np.float64)
                if np.isfinite(vec).all():
                    ids.append(int(vec_id))
                    dims.append(len(vec))
                    out.append(np.floor(scale * vec).astype("<f8").tobytes())
            yield pd.DataFrame({"vec_id": pd.Series(ids, dtype="int64"), "dim": pd.Series(dims, dtype="int64"), "vec": out})

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(parse, "vec_id long, dim long, vec binary")


def with_cells(rows: DataFrame, counts: dict[int, int], of: int) -> DataFrame:
    """The rows of the lengths in ``counts`` with ``cell``, their nearest pivot. Pivots are the rows of the lowest hashes, two for
    each ``of`` rows up to a bound; they only decide in which block a row is."""
    pivots = {}
    for dim, n in counts.items():
        most = max(1, min(PIVOTS, PIVOT_COMPONENTS // max(1, dim), 2 * (-(-n // of))))
        own = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(most).select("vec")
        pivots[dim] = np.stack([np.frombuffer(r.vec, "<f8") for r in own.collect()])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim", sort=False):
                centres = pivots[int(dim)]
                points = np.stack([np.frombuffer(v, "<f8") for v in some.vec])
                gap = (centres**2).sum(axis=1)[None, :] - 2 * (points @ centres.T)
                yield some.assign(cell=gap.argmin(axis=1).astype(np.int64))

    known = rows.where(F.col("dim").isin(list(counts)))
    return known.mapInPandas(assign, "vec_id long, dim long, vec binary, cell long")


def block_trees(cells: DataFrame, of: int) -> DataFrame:
    """A tree per block: each cell is dealt by hash into blocks of about ``of`` rows. Beside the tree: the number of
    rows, and a ball (centre, radius) that holds them all."""

    def index(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        points = np.stack([np.frombuffer(v, "<f8") for v in group.vec])
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
        tree = CoverTree.build(group.vec_id.to_numpy(np.int64), points)
        first = group.iloc[0]
        return pd.DataFrame(
            {"dim": [first.dim], "number": [first.number], "n": [len(group)], "centre": [centre], "radius": [radius], "tree": [pickle.dumps(tree, protocol=5)]}
        )

    # one row per pivot: a bounded list
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / of).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts"))
    dealt = cells.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("number", F.col("cell") * F.lit(1 << 40) + part)
    return dealt.groupBy("dim", "number").applyInPandas(index, BLOCKS)


def block_bounds(queries: DataFrame, trees: DataFrame) -> DataFrame:
    """dim, query_number, number, bound: no product between the two blocks exceeds ``bound``. Only balls are moved; every
    ball of queries meets every ball of data of its length once, in as many tasks as there are shuffle partitions."""

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, a: total + a)

    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = trees.select("dim", "number", "centre", "radius").withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(parts)))
    asked = queries.select("dim", F.col("number").alias("query_number"), F.col("centre").alias("query_centre"), F.col("radius").alias("query_radius"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    norm, query_norm = F.sqrt(dot("centre", "centre")), F.sqrt(dot("query_centre", "query_centre"))
    bound = dot("query_centre", "centre") + query_norm * F.col("radius") + F.col("query_radius") * (norm + F.col("radius"))
    pairs = data.join(asked, ["dim", "salt"]).withColumn("bound", bound)
    # rounding never drops a pair
    return pairs.select("dim", "query_number", "number", (F.col("bound") + F.lit(1e-9) * (F.abs("bound") + 1)).alias("bound"))


def search_pairs(pairs: DataFrame, queries: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query of each pair of blocks (dim, query_number, number, floor): dim, query_number,
    query_id, vec_id, score. Scores below ``floor`` may be left out."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = DualSearch(pickle.loads(row.query_tree), pickle.loads(row.tree), k, row.floor)
                found.run()
                yield found.results().assign(dim=row.dim, query_number=row.query_number)

    asked = queries.select("dim", F.col("number").alias("query_number"), F.col("tree").alias("query_tree"))
    both = pairs.join(trees.select("dim", "number", "tree"), ["dim", "number"]).join(asked, ["dim", "query_number"])
    both = both.repartition("dim", "number", "query_number").select("dim", "query_number", "floor", "query_tree", "tree")
    return both.mapInPandas(search, "dim long, query_number long, query_id long, vec_id long, score long")


def open_pairs(bounds: DataFrame, done: DataFrame, best: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The pairs that may still hold a better or equal score than what ``best`` has for some query of the block, with that
    block's worst k-th score as ``floor``. A block where a query has fewer than ``k`` keeps all its pairs."""
    kth = best.groupBy("dim", "query_number", "query_id").agg(F.count("*").alias("found"), F.min("score").alias("score"))
    worst = kth.where(F.col("found") >= k).groupBy("dim", "query_number").agg(F.count("*").alias("full"), F.min("score").alias("score"))
    floors = queries.select("dim", F.col("number").alias("query_number"), "n").join(worst, ["dim", "query_number"], "left")
    floor = F.when(F.col("full") >= F.col("n"), F.col("score").cast("double")).otherwise(F.lit(float("-inf")))
    floors = floors.select("dim", "query_number", floor.alias("floor"))
    left = bounds.join(done, ["dim", "query_number", "number"], "left_anti").join(floors, ["dim", "query_number"])
    return left.where("bound >= floor").select("dim", "query_number", "number", "floor")


def search_blocks(rows: DataFrame, k: int, every: int, block: int, query_block: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """All candidates (query_id, vec_id, score) of the two rounds, the bounds of all pairs of blocks, and the pairs of
    the second round; None without queries."""
    mine = F.col("vec_id") % every == 0
    # lengths of vectors with queries are few
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(mine, 1)).alias("q")).where("q > 0").collect()
    if not sizes:
        return None
    cells = stored(with_cells(rows, {r.dim: r.n for r in sizes}, block))
    trees, queries = stored(block_trees(cells, block)), stored(block_trees(cells.where(mine), query_block))
    bounds = stored(block_bounds(queries, trees))
    top = bounds.groupBy("dim", "query_number").agg(F.max(F.struct("bound", "number")).alias("top"))
    first = top.select("dim", "query_number", F.col("top.number").alias("number"), F.lit(float("-inf")).alias("floor"))
    best = stored(search_pairs(first, queries, trees, k))
    rest = stored(open_pairs(bounds, first, best, queries, k))
    found = best.unionByName(search_pairs(rest, queries, trees, k)).select("query_id", "vec_id", "score")
    return found, bounds, rest


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = 4096, query_block: int = 2048
) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``: the ``k`` other rows of the
    highest integer inner product, ties to the smaller id, as query_id, rank (from 1), vec_id, score.

    Rows without id or vector, or with null or non-finite components, take no part; vectors of another length than
    a query's are not compared with it. Rows of a query's own id are its own. Repeated rows count once. Products are
    exact below 2 ** 53. Extra columns are ignored; empty input, and a query without others, give no rows.

    ``block`` and ``query_block`` bound what a task holds. Rows of one cell are dealt to its blocks by a hash, so equal
    vectors are spread; a pair of blocks meets at most once, and returns at most ``k`` rows per query."""
    rows = stored(whole_vectors(vectors, scale).dropDuplicates(["vec_id", "vec"]))
    searched = search_blocks(rows, k, every, block, query_block)
    if searched is None:
        return rows.where("false").selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0L AS score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = searched[0].dropDuplicates().withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
