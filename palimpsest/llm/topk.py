"""Exact top-k search by inner product: columnar branch and bound over dimension blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, in_batches, shared

#: Queries that one pass over the candidates serves, on average at most; dimensions accumulated between two bounds.
QUERIES, BLOCK = 8_192, 16
#: Queries and candidates that meet at once; the share of their pairs below which survivors go on pair by pair; tasks that give rows, at least.
GROUP, CHUNK, SPARSE, TASKS = 256, 1_024, 0.1, 256
SCALE = 256.0


def _vectors(rows: list[list[float]]) -> np.ndarray:
    """Whole-number vectors, one a row, shorter ones filled up with zeros."""
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.floor(out * SCALE)


def _blocks(x: np.ndarray, order: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vertical layout: the vectors by blocks of dimensions, in the given order, and before each block the norm of what remains."""
    x = np.pad(x, ((0, 0), (0, max(0, len(order) - x.shape[1]))))[:, order]
    cuts = range(0, max(len(order), 1), BLOCK)
    square = [(x[:, c : c + BLOCK] ** 2).sum(1) for c in cuts]
    mass = np.sqrt(np.cumsum(square[::-1], axis=0)[::-1])
    return [np.ascontiguousarray(x[:, c : c + BLOCK]) for c in cuts], list(mass)


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=False))))


class Best:
    """The k best (score, id) of each query so far. Queries of like direction are in one group, so that a group needs few candidates.

    survivors counts the pairs of query and candidate that each block of dimensions was computed for, and all pairs last.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.at = self._near(x)
        self.ids, self.x, self.k = ids[self.at], x[self.at], k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.width, self.split, self.order = -1, ([], []), np.zeros(0, np.int64)
        self.survivors = np.zeros(1, np.int64)

    @staticmethod
    def _near(x: np.ndarray) -> np.ndarray:
        """Order of the queries: by the nearest of some of them, by direction."""
        if len(x) <= GROUP:
            return np.arange(len(x))
        unit = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
        centre = unit[:: max(1, len(x) // (len(x) // GROUP + 1))]
        return np.argsort((unit @ centre.T).argmax(1), kind="stable")

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take candidates in, the longest first: partial sums grow a block at a time, and candidates that can't be among a query's best drop out."""
        if not len(ids) or not len(self.ids):
            return
        width = max(self.x.shape[1], x.shape[1])
        if width != self.width:
            # heavy dimensions first: what remains gets small soon
            self.width, self.order = width, np.arange(width)
            self.order[: self.x.shape[1]] = np.argsort(-(self.x**2).sum(0), kind="stable")
            self.split = _blocks(self.x, self.order)
            self.survivors = np.zeros(len(self.split[0]) + 1, np.int64)
        wide = float(np.abs(self.x).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1) >= 2.0**52
        own, mass = _blocks(x, self.order)
        for c in np.array_split(by := np.argsort(-mass[0], kind="stable"), -(-len(by) // CHUNK)):
            parts, rest = [p[c] for p in own], [m[c] for m in mass]
            for a in range(0, len(self.ids), GROUP):
                group = slice(a, min(a + GROUP, len(self.ids)))
                if wide:
                    i, j = np.divmod(np.arange((group.stop - a) * len(c)), len(c))
                    score = np.array([float(_exact(self.x[a + q], x[c[w]])) for q, w in zip(i, j, strict=True)])
                else:
                    i, j, score = self._pairs(group, parts, rest)
                other = self.ids[a + i] != ids[c[j]]
                self._keep(group, i[other], ids[c[j[other]]], score[other])

    def _pairs(self, group: slice, own: list[np.ndarray], mass: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of a group's pairs that may be among the query's best."""
        parts, rest = ([x[group] for x in y] for y in self.split)
        least = self.score[group, -1]
        # a bound may be short by what rounding takes
        slack = 1 + 1e-9
        live, total = np.arange(len(mass[0])), np.zeros((len(least), len(mass[0])))
        self.survivors[-1] += total.size
        for b in range(len(parts)):
            may = total + rest[b][:, None] * mass[b][live][None] * slack >= least[:, None]
            if may.mean() < SPARSE:
                i, j = np.nonzero(may)
                score, j = total[i, j], live[j]
                for later in range(b, len(parts)):
                    self.survivors[later] += len(i)
                    score = score + np.einsum("pd,pd->p", parts[later][i], own[later][j])
                    more = rest[later + 1][i] * mass[later + 1][j] * slack if later + 1 < len(parts) else 0
                    keep = score + more >= least[i]
                    i, j, score = i[keep], j[keep], score[keep]
                return i, j, score
            need = may.any(0)
            if need.mean() < 0.75:
                live, total = live[need], total[:, need]
            self.survivors[b] += total.size
            total += parts[b] @ own[b][live].T
        i, j = np.nonzero(total >= least[:, None])
        return i, live[j], total[i, j]

    def _keep(self, group: slice, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge new (query, id, score) into the best of a group."""
        if not len(i):
            return
        n = group.stop - group.start
        old = self.found[group] >= 0
        query = np.concatenate([np.nonzero(old)[0], i])
        score, found = np.concatenate([self.score[group][old], score]), np.concatenate([self.found[group][old], ids])
        order = np.lexsort((found, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        order, query, place = order[top], query[top], place[top]
        new, own = np.full((n, self.k), -np.inf), np.full((n, self.k), -1, np.int64)
        new[query, place], own[query, place] = score[order], found[order]
        self.score[group], self.found[group] = new, own


def usable(table: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of rows whose vector is not null and holds no null and no non-finite component."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).where(~bad).select(F.col(id_).cast("long").alias("vec_id"), x.alias("embedding"))


def search(table: DataFrame, is_query, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest inner products, over all rows but those of its own id.

    Components are floor(256 * x); scores are exact whole numbers (beyond 2**52: the nearest double, within a long's
    range); ties go to the smaller vec_id. Vectors of other lengths are filled up with zeros. A query id that repeats
    keeps its lowest vector; a candidate row that repeats takes a place each time. No queries, or no candidates, give
    no rows.

    The queries go over the candidates in blocks of about QUERIES, and the candidates are read once for each block; a
    block is what the driver holds and broadcasts. A task gives k rows for each query at most, so candidates are read by
    no more tasks than keep the cluster busy.
    """
    rows = usable(table, id_, vector)
    stated = shared(rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    blocks = max(1, -(-stated.count() // QUERIES))
    out = None
    for b in range(blocks):
        own = stated.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        found = _pass(rows, sorted((r["vec_id"], r["embedding"]) for r in own), k)
        found = found if blocks == 1 else shared(found)
        out = found if out is None else out.union(found)
    drop(stated)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries], np.int64), _vectors([x for _, x in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = given.value
        best = Best(ids, x, k)
        for batch in batches:
            best.offer(batch.column(0).to_numpy(), _vectors(batch.column(1).to_pylist()))
        q, j = np.nonzero((best.found >= 0) & np.isfinite(best.score))
        score = best.score[q, j]
        whole = [int(s) for s in np.clip(score, -(2.0**63), 2.0**63 - 1024)]
        yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.found[q, j]), pa.array(whole, pa.int64())], ["query_id", "vec_id", "score"])

    tasks = max(TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return in_batches(rows.coalesce(tasks), run, "query_id long, vec_id long, score long")
