"""Connected components of an edge table, by large-star and small-star steps.

Up to ``ONE_TASK`` edges one task of an executor joins them all: a round costs the
driver some ten plans and their code, whatever the number of edges, and its memory
fills with those.  More edges go by steps.  Each step groups edges by an end and points the neighbours to the smallest one;
the two in turn make every component a star around its smallest node in a number
of rounds that grows with the logarithm of its size.  Nothing is collected; each
round's edges are written to the shared checkpoint folder.  The tables of minima
are written before they are joined, so that both sides of a join are plain
shuffles, whose large partitions Spark can split when one node has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, stored

#: Most edges (two numbers each) joined by one task.
ONE_TASK = 1 << 21


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
    if held:
        nodes, roots = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for k in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (nodes, roots)], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return (row[0], row[1])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node of the component) for all nodes of edges (a, b); loops are left out."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_joined, "node long, root long")
    before = _state(now)
    small = lambda df: stored(few(df, before[0]))
    now = few(now, before[0])
    for _ in range(rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = small(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = small(now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = small(large.groupBy("u").agg(F.min("v").alias("m")))
        pointed = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = small(pointed.select("e.u", "e.v").where("u <> v").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
