"""Errors put into schemas, and the sweep that scores them.

A trial takes its candidates in an order that a hash of (seed, trial, candidate)
gives, so any number of trials is made in one plan and each is the same again on
a rerun.  A trial is a schema row of its own: scoring takes all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import Weights
from ..model import EDGE, NODE
from .flatten import _plain
from .scoring import schema_f1, score

NODE_ERRORS = ("node_type_missing", "node_label_missing", "node_property_missing", "node_duplicate")
EDGE_ERRORS = ("edge_type_missing", "edge_property_missing", "edge_duplicate", "edge_direction_swapped", "edge_cardinality_error")
RATIO_ERRORS = ("node_property_missing", "edge_property_missing")
KINDS = (*NODE_ERRORS, *EDGE_ERRORS, "node_random", "edge_random")


def _order(seed: int, trial: int, *of) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, (seed, trial, *of))))


def remove_share(types: list[dict], level: int, seed: int, trial: int) -> None:
    """Takes level * 10 % of all (type, property) pairs away, one at least, half rounded up."""
    pool = [(k, p) for k, t in enumerate(types) for p in (*t["mandatory"], *t["optional"])]
    if not pool:
        return
    count = min(len(pool), max(1, (len(pool) * level + 5) // 10))
    for k, p in sorted(pool, key=lambda x: _order(seed, trial, *x))[:count]:
        for kind in ("mandatory", "optional"):
            types[k][kind] = [x for x in types[k][kind] if x != p]


def _one(kind: str, nodes: list[dict], edges: list[dict], used: set[str], seed: int, trial: int, step: int) -> bool:
    """One error of the kind on a type not used yet; False if none is left."""
    of_node = kind.startswith("node_")
    types, name = (nodes, "type_id") if of_node else (edges, "edge_id")
    fresh = [t for t in types if t[name] not in used]
    part = {"node_label_missing": ("labels",), "node_property_missing": ("mandatory", "optional"), "edge_property_missing": ("mandatory", "optional")}.get(kind)
    pool = [(t, x) for t in fresh for x in ([v for c in part for v in t[c]] if part else [""])]
    if not pool:
        return False
    chosen, value = min(pool, key=lambda c: _order(seed, trial, step, c[0][name], c[1]))
    used.add(chosen[name])
    if part:
        for c in part:
            chosen[c] = [v for v in chosen[c] if v != value]
    elif kind.endswith("_missing"):
        types.remove(chosen)
        if of_node:
            edges[:] = [e for e in edges if chosen[name] not in (e["src_type"], e["dst_type"])]
    elif kind.endswith("_duplicate"):
        types.append({**chosen, name: f"copy_{step}_{chosen[name]}"})
    elif kind == "edge_direction_swapped":
        chosen["src_type"], chosen["dst_type"] = chosen["dst_type"], chosen["src_type"]
    elif kind == "edge_cardinality_error":
        chosen["card_error"] = True
    else:
        raise ValueError(f"no such kind of error: {kind}")
    return True


def inject(nodes: list[dict], edges: list[dict], kind: str, level: int, cardinality: bool, seed: int, trial: int) -> None:
    """Changes the types in place: ``level`` errors of a kind, or a share for missing properties."""
    if kind == "edge_cardinality_error" and not cardinality:
        return
    if kind in RATIO_ERRORS:
        remove_share(nodes if kind.startswith("node") else edges, level, seed, trial)
        return
    choices = {"node_random": NODE_ERRORS, "edge_random": EDGE_ERRORS if cardinality else EDGE_ERRORS[:-1]}.get(kind, (kind,))
    used: set[str] = set()
    for step in range(level):
        pick = choices[_order(seed, trial, "kind", step) % len(choices)]
        if not _one(pick, nodes, edges, used, seed, trial, step):
            return


def trials(schemas: DataFrame, kinds: tuple[str, ...] = KINDS, levels: tuple[int, ...] = (1, 2, 3, 4, 5), n: int = 100, seed: int = 42, cardinality: bool = False) -> DataFrame:
    """schema_id, truth_id, kind, level, trial, nodes, edges: a schema row for each trial."""
    spark = schemas.sparkSession
    grid = spark.createDataFrame([(k, v) for k in kinds for v in levels], "kind string, level int")
    cells = schemas.join(F.broadcast(grid)).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # a fixed grid
    cells = cells.select(F.concat_ws("/", "schema_id", "kind", "level", "trial").alias("schema_id"), F.col("schema_id").alias("truth_id"), "kind", "level", "trial", "nodes", "edges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, edges = [_plain(x) for x in batch["nodes"]], [_plain(x) for x in batch["edges"]]
            for n_, e_, kind, level, trial in zip(nodes, edges, batch["kind"], batch["level"], batch["trial"], strict=True):
                inject(n_, e_, kind, int(level), cardinality, seed, int(trial))
            yield batch.assign(nodes=nodes, edges=edges)

    return cells.repartition("kind", "level").mapInPandas(run, f"schema_id string, truth_id string, kind string, level int, trial int, nodes array<{NODE}>, edges array<{EDGE}>")


def remove_first_properties(schemas: DataFrame, level: int) -> DataFrame:
    """schema_id, type_id, prop of the share of node properties taken away in order of their names.

    The plain relational form of ``remove_share``, for a fixed order of candidates.
    """
    pool = schemas.select("schema_id", F.explode("nodes").alias("t")).select("schema_id", "t.type_id", F.explode(F.concat("t.mandatory", "t.optional")).alias("prop"))
    of = Window.partitionBy("schema_id")
    place, total = F.row_number().over(of.orderBy("type_id", "prop")), F.count("*").over(of)
    count = F.least(total, F.greatest(F.lit(1), F.floor((total * level + 5) / 10)))
    return pool.withColumn("place", place).withColumn("count", count).where("place <= count").select("schema_id", "type_id", "prop")


def property_totals(schemas: DataFrame) -> DataFrame:
    """schema_id, node_props, edge_props."""
    total = lambda types: F.aggregate(types, F.lit(0), lambda s, t: s + F.size(t["mandatory"]) + F.size(t["optional"]))
    return schemas.select("schema_id", total(F.col("nodes")).alias("node_props"), total(F.col("edges")).alias("edge_props"))


def sweep(schemas: DataFrame, inst_nodes: DataFrame, inst_edges: DataFrame, w: Weights = Weights(), **options) -> DataFrame:
    """kind, level, trials and mean scores: C2 against the instance, F1 against the schema without errors."""
    made = trials(schemas, **options).cache()
    scores = score(made.select("schema_id", "nodes", "edges"), inst_nodes, inst_edges, w)
    f1 = schema_f1(made, schemas)
    rows = made.select("schema_id", "truth_id", "kind", "level").join(scores, "schema_id").join(f1, "schema_id")
    means = [F.avg(c).alias(c) for c in (*scores.columns[1:], *f1.columns[1:])]
    return rows.groupBy("truth_id", "kind", "level").agg(F.count("*").alias("trials"), *means)


