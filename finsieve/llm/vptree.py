"""Nearest neighbours by inner product with a vantage-point tree per shard.

With M the largest norm, a vector x gets the further component sqrt(M^2 - |x|^2) and a query gets 0
there: the squared distance is then M^2 + |q|^2 - 2 <q, x>, so near means large inner product and
the triangle inequality holds. A branch is left out when its bound, times `factor`, is beyond the
k-th best so far: factor 1 is exact, larger factors leave out more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, shared_path, stored

LEAF = 256
#: Vectors of a shard; queries of a block that is broadcast, and bytes of their components, as expected by hashing.
SHARD_ROWS, BLOCK_ROWS, BLOCK_BYTES = 8192, 16_384, 16 << 20
#: Distinct vectors kept beyond k, so that sums in another order can't cost a place.
SLACK = 8
#: Part of the squared distances within which scores may tie, and queries with ties that are compared with a whole shard at a time.
TIED, TIED_ROWS = 1e-12, 256


class VpTree:
    """Vantage-point tree over the rows of x (shard rows with the further component)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.root = self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        spread = np.linalg.norm(self.x[rows] - self.x[rows[0]], axis=1)
        vantage = rows[int(spread.argmax())]
        far = np.linalg.norm(self.x[rows] - self.x[vantage], axis=1)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2  # by position, so equal distances can't make a side empty
        return vantage, far[order[half - 1]], far[order[half]], self._build(rows[order[:half]], leaf), self._build(rows[order[half:]], leaf)

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, base: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Inner products and rows of the k best for each query, best first; -inf where there are fewer. base: M^2."""
        self.q, self.k, self.factor = q, k, factor
        self.offset = base + (q * q).sum(axis=1)
        self.best = np.full((len(q), k), -np.inf)
        self.rows = np.full((len(q), k), -1)
        self._visit(self.root, np.arange(len(q)))
        return self.best, self.rows

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        return np.sqrt(np.maximum(self.offset[who] - 2 * self.best[who, -1], 0)) * (1 + 1e-9)

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, who)
            return
        vantage, inner, outer, near, far = node
        distance = np.linalg.norm(self.q[who] - self.x[vantage], axis=1)
        first_near = distance <= (inner + outer) / 2
        for nearer in (True, False):
            side = who[first_near == nearer]
            gap = distance[first_near == nearer] - inner if nearer is False else outer - distance[first_near == nearer]
            self._visit(near if nearer else far, side)
            self._visit(far if nearer else near, side[gap * self.factor <= self._reach(side)])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        products = self.q[who] @ self.x[rows].T
        better = products.max(axis=1) > self.best[who, -1]
        who, products = who[better], products[better]
        if not len(who):
            return
        values = np.hstack([self.best[who], products])
        places = np.hstack([self.rows[who], np.broadcast_to(rows, (len(who), len(rows)))])
        top = np.argpartition(-values, self.k - 1, axis=1)[:, : self.k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(values, top, 1), axis=1, kind="stable"), 1)
        self.best[who], self.rows[who] = np.take_along_axis(values, top, 1), np.take_along_axis(places, top, 1)


def summed(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that equal vectors give equal sums."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * x[:, i]
    return total


def shard_best(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int, factor: float, largest: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, ...]]:
    """(query's place, ids, scores) of each query's k best of a shard; of equal vectors those of the smallest ids.

    Equal vectors are one row of the tree. A query's own row isn't counted. Where the last that the
    tree kept ties with the k-th, others may have been left out that tie too: all are compared then.
    """
    order = np.lexsort((rows, ids))
    x, ids, rows = x[order], ids[order], rows[order]
    _, first, inverse = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    distinct = x[first]
    members = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[members], np.arange(len(first) + 1))
    more = np.sqrt(np.maximum(largest**2 - (distinct * distinct).sum(axis=1), 0))
    tree = VpTree(np.column_stack([distinct, more]), leaf)
    n = min(k + SLACK, len(distinct))
    best, places = tree.search(np.column_stack([q, np.zeros(len(q))]), n, factor, largest**2)
    found, least = list(places), best[:, min(k, n - 1)] - TIED * tree.offset
    tied = np.flatnonzero(best[:, -1] >= least) if n < len(distinct) else np.zeros(0, int)
    for at in range(0, len(tied), TIED_ROWS):
        some = tied[at : at + TIED_ROWS]
        for i, products in zip(some, q[some] @ distinct.T):
            found[i] = np.flatnonzero(products >= least[i])
    for i in range(len(q)):
        own = np.concatenate([members[starts[d] : min(starts[d + 1], starts[d] + k + 1)] for d in found[i] if d >= 0])
        own = own[rows[own] != q_rows[i]]
        scores = summed(np.broadcast_to(q[i], (len(own), q.shape[1])), x[own])
        top = np.lexsort((ids[own], -scores))[:k]
        yield i, ids[own[top]], scores[top]


def matrices(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, vectors) for each length that the batch's vectors have."""
    lists = batch.column(column)
    flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, flat[starts[at][:, None] + np.arange(n)]


class Best:
    """The k best of each of a block's queries of one length, over all shards that were searched so far."""

    def __init__(self, block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
        self.ids, self.rows, self.q = block
        self.k, self.near = k, [(np.zeros(0, np.int64), np.zeros(0))] * len(self.ids)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.waiting.append((x, ids, rows))
        self.n_waiting += len(ids)

    def search(self, factor: float, largest: float) -> None:
        """Search what waits as one shard."""
        if not self.waiting:
            return
        x, ids, rows = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        for i, near, scores in shard_best(x, ids, rows, self.q, self.rows, self.k, factor, largest):
            near, scores = np.concatenate([self.near[i][0], near]), np.concatenate([self.near[i][1], scores])
            top = np.lexsort((near, -scores))[: self.k]
            self.near[i] = near[top], scores[top]

    def batch(self) -> pa.RecordBatch:
        counts = [len(n) for n, _ in self.near]
        near, scores = (np.concatenate([np.zeros(0, t), *[n[i] for n in self.near]]) for i, t in ((0, np.int64), (1, float)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(self.ids, counts), np.repeat(self.rows, counts), near, scores)], names=["query_id", "query_row", "vec_id", "score"])


def searched(rows: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, factor: float, shard_rows: int, largest: float) -> DataFrame:
    """(query_id, query_row, vec_id, score): the k best in each of rows' partitions for each query of the block, which is broadcast.

    A partition is searched where it lies, a shard at a time, and sends at most k rows a query on.
    """
    asked = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(part, k) for n, part in asked.value.items()}
        for batch in batches:
            ids, row = (batch.column(c).to_numpy() for c in ("vec_id", "row"))
            for n, at, x in matrices(batch):
                if n not in best:
                    continue
                for i in range(0, len(at), shard_rows):
                    part = at[i : i + shard_rows]
                    if best[n].n_waiting + len(part) > shard_rows:
                        best[n].search(factor, largest)
                    best[n].add(x[i : i + shard_rows], ids[part], row[part])
        for one in best.values():
            one.search(factor, largest)
            yield one.batch()

    return rows.select("vec_id", "row", "v").mapInArrow(run, "query_id long, query_row long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the SQL condition `queries` names, the k other rows of largest inner product.

    Vectors lie in the shared folder and aren't shuffled: each partition is searched in place, shard
    after shard of shard_rows rows. Queries are broadcast in blocks that are bounded in rows and
    bytes, a job each over all vectors, and only each partition's k best of a query are shuffled, cut
    to k again before they meet. The work is that of queries times rows, less what the bounds leave out.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows with a null id. Vectors of different lengths have no product, so each finds those of its own.
    Equal scores stand by smaller id; a repeated id is as many rows, of which a query leaves out its
    own alone. With fewer than k others all are returned; an empty table gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    given = F.col(quoted(vector_col))
    finite = F.forall(given, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sound = vectors.where(given.isNotNull() & F.col(quoted(id_col)).isNotNull()).where(finite & F.exists(given, lambda x: x != 0))
    made = sound.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), given.cast("array<double>").alias("v"), F.expr(queries).alias("asked"))
    rows = stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.count_if("asked").alias("asked"), F.sum(F.when(F.col("asked"), F.size("v") * 8)).alias("bytes")).first()
    if not facts["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_blocks = max(-(-facts["asked"] // block_rows), -(-facts["bytes"] // BLOCK_BYTES))
    largest = facts["norm"] * (1 + 1e-12)
    index = rows.coalesce(-(-facts["n"] // shard_rows))
    path = shared_path(spark, "vector-neighbours")
    for b in range(n_blocks):
        asked = rows.where("asked").where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).select("vec_id", "row", "v").toArrow()
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in asked.to_batches():
            for n, at, q in matrices(batch):
                parts.setdefault(n, []).append((batch.column("vec_id").to_numpy()[at], batch.column("row").to_numpy()[at], q))
        block = {n: tuple(np.concatenate(c) for c in zip(*found)) for n, found in parts.items()}
        found = searched(index, block, k, factor, shard_rows, largest)
        if n_blocks > 1:
            found.write.mode("append").parquet(path)
    made = found if n_blocks == 1 else spark.read.schema(found.schema).parquet(path)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return made.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
