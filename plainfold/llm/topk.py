"""Exact top-k by inner product, by the three-phase uniform threshold.

A vector's components are dealt to ``lists`` lists of neighbouring dimensions; its score is the sum of its part scores.
Queries come in blocks of at most ``block`` vectors, so what is broadcast has a fixed size; each block is held against
all vectors, which stay where they are read.

1. Each task gathers, from the first ``head`` entries that it reads, the k best scores. The k-th best over all tasks is a
   floor that the k-th best score can't be under, as it is one of any part of the vectors.
2. The floor over the number of lists is a safe cutoff: a score that reaches the floor has a part that reaches the cutoff.
   It is broadcast with the queries. Tasks go through the lists and collect the entries that reach it in any list; entries
   that can't any more, as parts are at most the product of both parts' lengths, are left. A task's own k best raise its
   floor as it goes on.
3. The remaining parts of the entries collected are resolved, as long as what is known and the lengths of the rest may
   reach the floor; the k best stay, first in each task, then overall.

Components are floor(scale * x), from the value as a double; scores are integer inner products, computed in doubles where
these are exact and in Python's integers beyond. Ties go to the smaller id. Defined results: vectors that are null or hold
null or non-finite components take no part, nor do rows without id; repeated ids count once (``one_per_id``); shorter
vectors are filled up with 0; an empty table gives an empty result. Other columns aren't read. Scores beyond 64 bits are
held at its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_per_id, save, work

EXACT = float(1 << 53)
ROWS = 512  #: vectors that are multiplied at once; the next ones meet the floor that these have raised
SPARSE = 8  #: share of pairs, one in so many, from which they are multiplied one by one
SLACK = 1 + 1e-9  #: of lengths, which are rounded
FOUND = "query_id long, vec_id long, score long"


def _whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: as doubles where that is exact, else as Python's integers."""
    if len(flat) and float(np.abs(flat).max()) * scale >= EXACT:
        return np.array([math.floor(Fraction(x) * scale) for x in flat.tolist()], object)
    return np.floor(scale * flat)


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The components as whole numbers."""
    size = np.diff(column.offsets.to_numpy())
    flat = _whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    out = np.zeros((len(column), dims), flat.dtype)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all products of such vectors are exact in doubles."""
    return a.dtype != object != b.dtype and not (a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= EXACT)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not _exact(a, b):
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        out = np.array(whole(a).dot(whole(b).T), object).reshape(len(a), len(b))
        return np.clip(out, -(1 << 63), (1 << 63) - 1)
    return a @ b.T


def _below(score) -> float:
    """The greatest double that isn't over the score."""
    f = float(score)
    return f if f <= int(score) else float(np.nextafter(f, -np.inf))


class Best:
    """The k best entries of each query so far, and the number of products that it took to find them."""

    def __init__(self, q_ids: np.ndarray, k: int, floor: list | None = None):
        self.q_ids, self.k, self.products = q_ids, k, 0
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, object)) for _ in q_ids]
        self.floor = np.array([-np.inf if f is None else _below(f) for f in floor or [None] * len(q_ids)])

    def take(self, ids: np.ndarray, row: np.ndarray, col: np.ndarray, score: np.ndarray) -> None:
        """Entries ``row`` of ``ids`` have ``score`` with the queries ``col``."""
        on = (score >= self.floor[col]).astype(bool) & (ids[row] != self.q_ids[col])
        row, col, score = row[on], col[on], score[on]
        by = np.argsort(col, kind="stable")
        row, col, score = row[by], col[by], score[by]
        edges = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1], [True]])) if len(col) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            j = col[a]
            all_ids, all_score = np.concatenate([self.kept[j][0], ids[row[a:b]]]), np.concatenate([self.kept[j][1], score[a:b]])
            best = np.lexsort((all_ids, -all_score))[: self.k]
            self.kept[j] = all_ids[best], all_score[best]
            if len(best) == self.k:
                self.floor[j] = max(self.floor[j], _below(all_score[best[-1]]))

    def batch(self) -> pa.RecordBatch:
        count = [len(x[0]) for x in self.kept]
        score = np.concatenate([x[1] for x in self.kept]) if self.kept else np.zeros(0, object)
        return pa.record_batch({
            "query_id": pa.array(np.repeat(self.q_ids, count)), "vec_id": pa.array(np.concatenate([x[0] for x in self.kept]).astype(np.int64)), "score": pa.array(np.asarray(score).astype(np.int64)),
        })

    def all_of(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        """Entries whose scores are all resolved."""
        row, col = np.divmod(np.arange(len(ids) * len(q)), max(1, len(q)))
        self.products += x.size * len(q)
        self.take(ids, row, col, _product(x, q).ravel())

    def collect(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray, cuts: list[np.ndarray]) -> None:
        """Phases 2 and 3 over some entries: list by list, pairs of an entry and a query stay while the parts known and the
        lengths of those to come let them reach the cutoff in some list, and the floor in all."""
        cutoff, floor = self.floor / len(cuts), self.floor
        lx, lq = (np.stack([np.sqrt((m[:, c] ** 2).sum(axis=1)) * SLACK for c in cuts], axis=1) for m in (x, q))
        # Of the lists from each one on: the length of all of them together, and of the longest.
        whole_x, whole_q = (np.sqrt(np.cumsum((m**2)[:, ::-1], axis=1)[:, ::-1]) * SLACK for m in (lx, lq))
        most_x, most_q = (np.maximum.accumulate(m[:, ::-1], axis=1)[:, ::-1] for m in (lx, lq))
        total, reached, pairs = np.zeros((len(ids), len(q))), np.zeros((len(ids), len(q)), bool), None
        for i, c in enumerate(cuts):
            last = i + 1 == len(cuts)
            if pairs is None:
                part = x[:, c] @ q[:, c].T
                self.products += part.size * len(c)
                total += part
                reached |= part >= cutoff
                if last:
                    stays = reached & (total >= floor)
                else:
                    stays = total + whole_x[:, i + 1, None] * whole_q[:, i + 1] >= floor
                    stays &= reached | (most_x[:, i + 1, None] * most_q[:, i + 1] >= cutoff)
                if last or stays.sum() * SPARSE <= stays.size:  # few enough to go on one by one
                    row, col = np.nonzero(stays)
                    pairs, score, sure = (row, col), total[row, col], reached[row, col]
                continue
            row, col = pairs
            part = np.concatenate([np.einsum("ij,ij->i", x[row[j : j + 65536, None], c], q[col[j : j + 65536, None], c]) for j in range(0, max(1, len(row)), 65536)])
            self.products += len(row) * len(c)
            score, sure = score + part, sure | (part >= cutoff[col])
            if last:
                on = sure & (score >= floor[col])
            else:
                on = score + whole_x[row, i + 1] * whole_q[col, i + 1] >= floor[col]
                on &= sure | (most_x[row, i + 1] * most_q[col, i + 1] >= cutoff[col])
            pairs, score, sure = (row[on], col[on]), score[on], sure[on]
        self.take(ids, *pairs, score)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column("vec_id").to_numpy(), _matrix(part.column("x"), dims, scale)


def _local(batches: Iterator[pa.RecordBatch], queries, dims: int, scale: int, k: int, head: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: per query, the k best scores among the first entries of the task."""
    q_ids, q = queries.value
    best, left = Best(q_ids, k), head
    for ids, x in _blocks(batches, dims, scale):
        best.all_of(ids[:left], x[:left], q)
        left -= len(ids)
        if left <= 0:
            break
    yield best.batch()


def _resolved(batches: Iterator[pa.RecordBatch], queries, floors, dims: int, scale: int, k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: per query, the k best of the task's entries that reach the cutoff in a list and the floor in all."""
    q_ids, q = queries.value
    best = Best(q_ids, k, floors.value)
    cuts = np.array_split(np.arange(dims), lists)
    for ids, x in _blocks(batches, dims, scale):
        if _exact(x, q) and _exact(x, x) and _exact(q, q):
            best.collect(ids, x, q, cuts)
        else:
            best.all_of(ids, x, q)
    yield best.batch()


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256, lists: int = 4, block: int = 4096, head: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the vectors whose id ``every`` divides."""
    spark = vectors.sparkSession
    at = work(spark)
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = one_per_id(vectors, "vec_id", "embedding").select("vec_id", x.alias("x")).where(whole)
    facts = rows.agg(F.max(F.size("x")).alias("dims")).first()
    dims = max(1, facts["dims"] or 0)
    lists = min(lists, dims)
    asked = rows.where(F.col("vec_id") % every == 0)
    found, after = [], None
    while True:
        part = (asked if after is None else asked.where(F.col("vec_id") > after)).orderBy("vec_id").limit(block).collect()  # at most a block
        if not part:
            break
        after = part[-1]["vec_id"]
        ids = np.array([r["vec_id"] for r in part], np.int64)
        values = _matrix(pa.array([r["x"] for r in part], pa.list_(pa.float64())), dims, scale)
        queries = spark.sparkContext.broadcast((ids, values))
        first = rows.mapInArrow(lambda b, q=queries: _local(b, q, dims, scale, k, head), FOUND)
        floor = {r["query_id"]: r["score"] for r in _ranked(first, k).where(F.col("rank") == k).collect()}  # one a query of the block
        floors = spark.sparkContext.broadcast([floor.get(int(i)) for i in ids])
        last = rows.mapInArrow(lambda b, q=queries, f=floors: _resolved(b, q, f, dims, scale, k, lists), FOUND)
        found.append(save(_ranked(last, k), at, f"block{len(found)}"))
        if len(part) < block:
            break
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
