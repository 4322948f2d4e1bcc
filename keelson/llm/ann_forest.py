"""Approximate nearest neighbours with a hash-prefix forest.

Every vector gets one long string of hash bits for each tree, the signs of its projections on random directions. A tree
is the sorted array of these strings. A query descends in each tree to the longest prefix it shares with any string,
which ends at another depth in every tree; then all trees ascend together, one bit of prefix at a time, and take in the
strings below, until the budget of candidates is there. The cosines of the candidates, and of no other row, are taken,
and rank them.

Rows are dealt by hash, once, into shards of bounded size, each with its own trees; the query set goes to every shard and
streams past its trees in blocks. The best of a query's candidates from all shards are its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import written

TREES, BITS = 96, 32
SHARD_ROWS, QUERY_ROWS = 16_384, 512
#: Candidates of a query in each shard: it ascends until it has so many. The README has what other budgets find.
CANDIDATES = 3072
SEED = 20


def _usable(vector: Column) -> Column:
    """Neither null nor zero, every component there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


class Forest:
    """Sorted hash arrays over the rows of one shard."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.bits = bits
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((unit.shape[1], trees * bits))
        self.keys = self.hashed(unit)
        self.order = np.argsort(self.keys, axis=0, kind="stable")
        self.arrays = np.take_along_axis(self.keys, self.order, axis=0)

    def hashed(self, unit: np.ndarray) -> np.ndarray:
        signs = (unit @ self.directions > 0).reshape(len(unit), -1, self.bits)
        return (signs.astype(np.uint64) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)

    def candidates(self, unit: np.ndarray, enough: int) -> np.ndarray:
        """Boolean matrix of queries and rows."""
        keys = self.hashed(unit)
        n, trees = self.arrays.shape
        taken = np.zeros((len(unit), n), bool)
        # Descent: the longest shared prefix is with a neighbour of the place where the key belongs.
        depth = np.zeros((len(unit), trees), np.int64)
        for t in range(trees):
            at = np.searchsorted(self.arrays[:, t], keys[:, t])
            for place in (np.minimum(at, n - 1), np.maximum(at - 1, 0)):
                differ = self.arrays[place, t] ^ keys[:, t]
                shared = self.bits - np.frexp(differ.astype(np.float64))[1]
                depth[:, t] = np.maximum(depth[:, t], shared)
        level, open_ = depth.max(axis=1), np.arange(len(unit))
        while len(open_):
            now = level[open_]
            shift = (self.bits - now).astype(np.uint64)
            for t in range(trees):
                low = (keys[open_, t] >> shift) << shift
                lo = np.searchsorted(self.arrays[:, t], low)
                hi = np.searchsorted(self.arrays[:, t], low + ((np.uint64(1) << shift) - np.uint64(1)), side="right")
                reached = np.flatnonzero((depth[open_, t] >= now) & (hi > lo))
                spans = hi[reached] - lo[reached]
                rows = np.repeat(open_[reached], spans)
                within = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
                taken[rows, self.order[np.repeat(lo[reached], spans) + within, t]] = True
            level[open_] -= 1
            open_ = open_[(taken[open_].sum(axis=1) < enough) & (level[open_] >= 0)]
        return taken


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, each from its own two vectors alone, so equal vectors have equal cosines."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


class _Shard:
    """The rows of one shard and, once a query comes, their forest."""

    def __init__(self, of: tuple[int, int]):
        self.of, self.ids, self.vectors, self.forest = of, [], [], None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def close(self, trees: bool) -> None:
        if self.forest is None and self.ids:
            ids, vectors = np.concatenate(self.ids), np.concatenate(self.vectors)
            order = np.argsort(ids, kind="stable")
            # Equal vectors are one entry of the trees; of their rows only the first k and the query's own can matter.
            self.distinct, where = np.unique(vectors[order], axis=0, return_inverse=True)
            where = where.reshape(-1)
            self.rows = ids[order][np.argsort(where, kind="stable")]
            self.starts = np.searchsorted(np.sort(where), np.arange(len(self.distinct) + 1))
            self.unit = self.distinct / np.linalg.norm(self.distinct, axis=1, keepdims=True)
            self.forest = Forest(self.unit) if trees else True
            self.ids = self.vectors = []

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, budget: int | None) -> list[tuple[int, int, float]]:
        self.close(budget is not None)
        if self.forest is None:
            return []
        asked = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        taken = self.forest.candidates(asked, max(8 * (k + 1), budget)) if budget is not None else None
        out: list[tuple[int, int, float]] = []
        for n, q in enumerate(ids.tolist()):
            some = np.flatnonzero(taken[n]) if budget is not None else np.arange(len(self.distinct))
            close = self.unit[some] @ asked[n] if budget is not None else self.unit @ asked[n]
            # What could be among the k + 1 best for all that rounding does; then exactly.
            floor = np.partition(close, -min(k + 1, len(close)))[-min(k + 1, len(close))] - 1e-9
            top = some[close >= floor]
            exact = cosines(vectors[n], self.distinct[top])
            best = [(-s, i, s) for s, d in zip(exact, top, strict=True) for i in self.rows[self.starts[d] : min(self.starts[d] + k + 1, self.starts[d + 1])].tolist() if i != q]
            out += [(q, i, s) for _, i, s in sorted(best)[:k]]
        return out


def _nearest(k: int, budget: int | None):
    """Rows (dim, shard, ask, id, vector), a shard's own before its queries, to (query_id, vec_id, score)."""

    def run(batches):
        shard = _Shard((-1, -1))
        for batch in batches:
            dim, number, asks, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            vectors = batch.column(4)
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = np.unique(np.concatenate([[0, batch.num_rows], cuts, np.arange(0, batch.num_rows, QUERY_ROWS)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (dim[a], number[a]) != shard.of:
                    shard = _Shard((dim[a], number[a]))
                piece = vectors.slice(a, b - a).flatten().to_numpy().reshape(b - a, dim[a])
                if not asks[a]:
                    shard.add(ids[a:b], piece)
                    continue
                found = shard.nearest(ids[a:b], piece, k, budget)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", budget: int | None = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest others found, ties to the smaller id.

    ``budget``: candidates of a query in a shard; None looks at every row, which is exact. Vectors that are null, zero,
    or hold a null or non-finite component take no part, and rows with a null id neither. Rows of one id and vector are
    one; an id is never its own neighbour. Vectors of another length than most are another space: each length is
    searched by itself. With fewer other rows than k all are found. An empty table gives an empty one. Other columns are
    not read. Memory of a task: one shard, its trees and one block of queries.
    """
    good = vectors.where(F.col(key).isNotNull() & _usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("ask")).dropDuplicates(["id", "vector"])
    good = written(good, "ann-vectors")
    shards = max(1, -(-good.count() // SHARD_ROWS))
    dealt = good.withColumn("dim", F.size("vector"))
    rows = dealt.select("dim", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "id", "vector")
    queries = dealt.where("ask").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "id", "vector")
    together = rows.unionByName(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "ask", "id")
    found = together.mapInArrow(_nearest(k, budget), "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """What search() approximates: every cosine of the query set with all rows, in blocks."""
    return search(vectors, is_query, k, key, vector, None)
