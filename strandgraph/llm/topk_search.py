"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

A vector is cut into segments.  Over a segment of n components the inner product
is n * mean * mean' plus the product of the deviations, which is n * deviation *
deviation' at most.  Summed, this bounds the inner product from above (and so the
distance from below).  From one segment to many the bound gets tighter: a vector
goes on to the next resolution only while its bound reaches the k-th best score
so far, and exact scores are computed for the survivors.

The queries go to the tasks in blocks of a fixed number, one job a block, and
every task keeps k candidates a query; the bounds carry a margin for rounding,
so results are exact.  Scores are computed in doubles where those are exact, else
in 64-bit or, beyond that, in whole numbers of any size.

Defined results: vectors that are null, hold a null or a non-finite component,
or whose id is null take no part; vectors of another length than the query are
no candidates; repeated ids are rows of their own, as queries too, each with its
own ranks, but a row is no candidate of a query of the same id; ties go to the
smaller id; components times the scale and scores beyond 64 bits stop at the ends
of that range; other columns are left out; no queries, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Queries sent to all tasks at once, and vectors handled at once.
BLOCK, ROWS = 4096, 1024


def quantized(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers; null where one is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(values, lambda x: F.floor(x * scale)))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a dot product is the bound."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            part = x[:, a:b].astype(np.float64)
            mean = part.mean(1)
            part -= mean[:, None]
            parts += [mean * np.sqrt(b - a), np.sqrt((part * part).sum(1))]
    return np.stack(parts, 1) if parts else np.zeros((len(x), 1))


class Search:
    """The best k of the vectors seen so far, for a block of queries of one length."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.marks, self.queries, self.k = ids, marks, queries, k
        self.widest = float(np.abs(queries.astype(np.float64)).max(initial=0))
        self.levels = [s for s in (1, 4, 16, 64) if s < queries.shape[1]]
        self.coarse = [statistics(queries, s) for s in self.levels]
        low = np.iinfo(np.int64).min
        self.scores = np.full((len(ids), k), low)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.real = np.zeros((len(ids), k), bool)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        worst = np.where(self.real.all(1), self.scores[:, -1], np.iinfo(np.int64).min).astype(np.float64)
        q = np.arange(len(self.ids))
        alive = np.ones((len(self.ids), len(ids)), bool)
        big = self.widest * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, vectors.shape[1])
        for level, mine in zip(self.levels, self.coarse, strict=True):
            bound = mine[q] @ statistics(vectors, level).T
            bound += 1e-6 * (1 + np.abs(bound)) + 1e-12 * big
            alive[q] &= np.clip(bound, -(2.0**63), 2.0**63) >= worst[q, None]
            q = q[alive[q].any(1)]
            if not len(q):
                return
        some = np.flatnonzero(alive[q].any(0))
        # Exact in doubles as long as sums stay below 2**53.
        kind = np.float64 if big < 2**52 else np.int64 if big < 2**62 else object
        scores = self.queries[q].astype(kind) @ vectors[some].astype(kind).T
        if kind is object:
            scores = np.clip(scores, -(2**63), 2**63 - 1)
        scores = scores.astype(np.int64)
        usable = alive[np.ix_(q, some)] & (self.ids[q, None] != ids[some][None, :])
        everything = np.concatenate([self.scores[q], np.where(usable, scores, np.iinfo(np.int64).min)], 1)
        owners = np.concatenate([self.found[q], np.broadcast_to(ids[some], scores.shape)], 1)
        real = np.concatenate([self.real[q], usable], 1)
        order = np.lexsort((owners, -everything.astype(np.float64) if kind is np.float64 else ~everything, ~real))[:, : self.k]
        self.scores[q] = np.take_along_axis(everything, order, 1)
        self.found[q] = np.take_along_axis(owners, order, 1)
        self.real[q] = np.take_along_axis(real, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        real = self.real.ravel()
        return np.repeat(self.marks, self.k)[real], np.repeat(self.ids, self.k)[real], self.found[self.real], self.scores[self.real]


def _matrices(ids: np.ndarray, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by vector length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.values)[lists.offsets[0].as_py() :] if len(lists) else np.zeros(0, np.int64)
    start = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield ids[rows], values[start[rows][:, None] + np.arange(n)[None, :]]


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``df`` for each row of ``queries``."""
    spark = df.sparkSession
    shape = lambda d: d.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("v")).where("vec_id is not null and v is not null")
    asked, rows = stored(shape(queries).withColumn("mark", F.monotonically_increasing_id())), shape(df)  # a mark a query row
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        chosen = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == b)
        table = chosen.toArrow()  # a block
        shared = spark.sparkContext.broadcast([*_matrices(np.stack([np.asarray(table[c], dtype=np.int64) for c in ("vec_id", "mark")], 1), table["v"])] if table.num_rows else [])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = {vectors.shape[1]: Search(own[:, 0], own[:, 1], vectors, k) for own, vectors in shared.value}
            for batch in batches:
                for ids, vectors in _matrices(np.asarray(batch.column(0)), batch.column(1)):
                    for a in range(0, len(ids), ROWS):
                        if vectors.shape[1] in searches:
                            searches[vectors.shape[1]].add(ids[a : a + ROWS], vectors[a : a + ROWS])
            for search in searches.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in search.rows()], ["mark", "query_id", "vec_id", "score"])

        parts.append(rows.mapInArrow(run, "mark long, query_id long, vec_id long, score long"))
    best = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy("mark").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(df: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """The query set of the registered query: ids divisible by 50."""
    return df.where(F.col(vec_id) % 50 == 0)
