"""Nearest neighbours by inner product: vantage-point trees per shard.

With one more coordinate, the square root of what its squared norm lacks of the largest, every vector has the same length, and
among those a larger inner product with a query is a smaller Euclidean distance. Each shard, a hash share of all vectors, builds
a vantage-point tree over its distinct vectors; queries come to it in blocks. A branch is left out when the least distance that
the triangle inequality allows, times `factor`, exceeds the distance of the worst neighbour kept; factor 1 is exact search.
Shards' lists are merged by query.

Defined cases: vectors that are null, empty, zero, or hold a null or a component that is not finite take no part, as queries or
candidates, nor do rows without an id; vectors of other lengths than a query's are no candidates of it. Rows that repeat a vec_id are candidates each, but
none of them for a query of that id; a query id with several rows asks with each, and its list holds the best pairs of all. Equal
vectors are one entry of a tree with the least ids that can count: of one id the k least rows at most, and 2 k rows, so that k
remain without any one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard on average, of a leaf at most, queries searched at once, pairs scored at once.
SHARD_ROWS, LEAF, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 16_384, 96, 1024, 200_000


@dataclass
class Node:
    """A leaf holds places first to last; else children with the range of their distances to the vantage point."""

    first: int
    last: int
    vantage: int = -1
    near: Node | None = None
    far: Node | None = None
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)


class Tree:
    """Over distinct vectors of one length, with the least ids of each that the k first without any one id can need."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, at = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first].astype(np.float64)
        self.bound = bound  # largest squared norm of all shards
        self.lift = np.sqrt(np.maximum(bound - (self.vectors**2).sum(axis=1), 0.0))
        by = np.argsort(at, kind="stable")  # by vector, then id
        change = np.concatenate(([True], (at[by][1:] != at[by][:-1]) | (ids[by][1:] != ids[by][:-1])))
        of_id = np.arange(len(by)) - np.maximum.accumulate(np.where(change, np.arange(len(by)), 0))
        by = by[of_id < k]
        begin = np.searchsorted(at[by], np.arange(len(first)))
        last_id = ids[by[np.append(begin[1:], len(by)) - 1]]
        within = np.arange(len(by)) - begin[at[by]]
        ids_kept = 2 * k
        self.ids = np.full((len(first), ids_kept), -1, np.int64)
        self.filled = np.zeros((len(first), ids_kept), bool)
        few = within < ids_kept
        self.ids[at[by][few], within[few]] = ids[by][few]
        self.filled[at[by][few], within[few]] = True
        self.alone = self.ids[:, 0] == last_id  # one id has all rows
        self.places = np.arange(len(first))
        self.random = np.random.default_rng(1)
        self.root = self._build(0, len(first))
        self.vectors, self.lift, self.ids, self.filled, self.alone = (x[self.places] for x in (self.vectors, self.lift, self.ids, self.filled, self.alone))

    def _build(self, first: int, last: int) -> Node:
        node = Node(first, last)
        if last - first <= LEAF:
            return node
        mine = self.places[first:last]
        best = (-1.0, None, None)
        for v in self.random.choice(mine, 4, replace=False):  # the one that spreads the others most
            d = np.sqrt(np.maximum(2 * (self.bound - self.vectors[mine] @ self.vectors[v] - self.lift[mine] * self.lift[v]), 0.0))
            best = max(best, (float(d.std()), v, d), key=lambda x: x[0])
        _, v, d = best
        order = np.argsort(d, kind="stable")
        self.places[first:last], d = mine[order], d[order]
        middle = (last - first) // 2
        node.vantage = int(v)
        node.near, node.near_range = self._build(first, first + middle), (float(d[0]), float(d[middle - 1]))
        node.far, node.far_range = self._build(first + middle, last), (float(d[middle]), float(d[-1]))
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and ids and scores of the k best of the shard, ties to the smaller id, without rows of its own id.

        Queries go through the tree together, so a leaf is one matrix product. First each goes down to the leaf that is nearest,
        whose k-th product is a bound; a second walk finds the k best products, which are rounded; the last, with the k-th as a
        fixed bound, takes all entries that reach it within rounding, and those are scored exactly and cut by score and id. So
        of different vectors with equal scores the least ids stay, whichever leaf they are in.
        """
        queries = queries.astype(np.float64)
        scores = np.full((len(queries), k), -np.inf)
        base = (queries**2).sum(axis=1) + self.bound
        slack = 8 * queries.shape[1] * np.finfo(float).eps * base
        limit = np.full(len(queries), -np.inf)  # what a query's k-th product reaches at least
        unsorted = np.empty_like(self.places)
        unsorted[self.places] = np.arange(len(self.places))

        def products(node: Node, q: np.ndarray) -> np.ndarray:
            found = queries[q] @ self.vectors[node.first : node.last].T
            found[self.alone[node.first : node.last] & (self.ids[node.first : node.last, 0] == query_ids[q, None])] = -np.inf
            return found

        def improve(node: Node, q: np.ndarray) -> None:
            found = products(node, q)
            better = found.max(axis=1) > np.maximum(scores[q, 0], limit[q] - slack[q])
            q = q[better]
            if len(q):
                every = np.concatenate((scores[q], found[better]), axis=1)
                every.partition(every.shape[1] - k, axis=1)
                scores[q] = every[:, -k:]  # the k-th best first

        best_scores = np.full((len(queries), k), -np.inf)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = [0]

        def collect(node: Node, q: np.ndarray) -> None:
            row, place = np.nonzero(products(node, q) >= np.maximum(limit[q] - slack[q], -np.finfo(float).max)[:, None])
            held.append((q[row], place + node.first))
            waiting[0] += len(row)
            if waiting[0] > PAIRS_AT_ONCE:
                settle()

        def settle() -> None:
            """Entries taken so far go into the lists of exact scores, the k first of each query by score and id."""
            q, p = (np.concatenate(x) for x in zip(*held))
            held.clear()
            waiting[0] = 0
            exact = np.zeros(len(q))  # component by component, so that it depends on nothing but the two vectors
            for d in range(queries.shape[1]):
                exact += self.vectors[p, d] * queries[q, d]
            entry, at = np.nonzero(self.filled[p] & (self.ids[p] != query_ids[q, None]))
            mine = np.unique(q)
            owner = np.concatenate((np.repeat(mine, k), q[entry]))
            all_scores = np.concatenate((best_scores[mine].ravel(), exact[entry]))
            all_ids = np.concatenate((best_ids[mine].ravel(), self.ids[p[entry], at]))
            by = np.lexsort((all_ids, -all_scores, owner))
            top = by[np.searchsorted(owner[by], mine)[:, None] + np.arange(k)]
            best_scores[mine], best_ids[mine] = all_scores[top], all_ids[top]

        def distance(node: Node, q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(base[q] - 2 * (queries[q] @ self.vectors[unsorted[node.vantage]]), 0.0))

        def descend(node: Node, q: np.ndarray) -> None:
            if node.near is None or not len(q):
                return improve(node, q) if len(q) else None
            near = distance(node, q) <= (node.near_range[1] + node.far_range[0]) / 2
            descend(node.near, q[near])
            descend(node.far, q[~near])

        # distances that cancel to nothing are wrong by the root of the rounding
        unsure = 2 * np.sqrt(slack)

        def visit(node: Node, q: np.ndarray, leaf) -> None:
            if node.near is None:
                return leaf(node, q)
            d = distance(node, q)
            for child, (low, high) in ((node.near, node.near_range), (node.far, node.far_range)):
                worst = np.sqrt(np.maximum(base[q] - 2 * np.maximum(scores[q, 0], limit[q]), 0.0))
                some = np.maximum(low - d, d - high) * factor <= worst + unsure[q]
                if some.any():
                    visit(child, q[some], leaf)

        every_query = np.arange(len(queries))
        descend(self.root, every_query)
        limit[:] = scores[:, 0]
        scores[:] = -np.inf
        visit(self.root, every_query, improve)
        limit[:] = np.maximum(scores[:, 0], limit)
        visit(self.root, every_query, collect)
        if held:
            settle()
        for own, ids, score in zip(query_ids.tolist(), best_ids, best_scores):
            n = int((score > -np.inf).sum())
            yield own, ids[:n], score[:n]


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the k nearest rows found for each query, nearest first, ties to the smaller id."""
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.withColumn("dim", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    known = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("bound")).collect()  # a row for each length of vectors
    shards = {r["dim"]: max(1, -(-r["n"] // shard_rows)) for r in known}
    bounds = {r["dim"]: r["bound"] for r in known}
    if not shards:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    count = F.element_at(F.create_map(*[F.lit(x) for p in shards.items() for x in p]), F.col("dim"))
    own = rows.select("dim", F.pmod(F.xxhash64("id"), count).cast("int").alias("shard"), F.lit(0).alias("turn"), "id", "v")
    asked = rows.where("asks").select("dim", F.explode(F.sequence(F.lit(0), count - 1)).alias("shard"), F.lit(1).alias("turn"), "id", "v")
    dealt = own.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        asking: list[np.ndarray] = []

        def answer() -> pa.RecordBatch:
            found = list(tree.search(np.concatenate(waiting), np.concatenate(asking), k, factor))
            waiting.clear(), asking.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

        for batch in batches:
            dims, parts, turns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(parts) != 0) | (np.diff(turns) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)]):
                if here != (dims[a], parts[a]):
                    if waiting:
                        yield answer()
                    here, tree = (dims[a], parts[a]), None
                    ids.clear(), vectors.clear()
                some = batch.slice(a, b - a)
                names, matrix = some.column(3).to_numpy(zero_copy_only=False), some.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dims[a])
                if turns[a] == 0:
                    ids.append(names)
                    vectors.append(matrix)
                    continue
                if tree is None and ids:
                    tree = Tree(np.concatenate(ids), np.concatenate(vectors), bounds[int(dims[a])], k)
                    ids.clear(), vectors.clear()
                if tree is None:
                    continue
                waiting.append(names)
                asking.append(matrix)
                if sum(map(len, waiting)) >= QUERIES_AT_ONCE:
                    yield answer()
        if waiting:
            yield answer()

    lists = dealt.mapInArrow(run, "query_id bigint, ids array<bigint>, scores array<double>")
    pairs = lists.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
