"""Resolve inheritance: schemas whose types have all they inherit.

A schema is one row, and flattening walks its few types in order, so it runs as a
map over rows: thousands of candidates or variants are flattened side by side.
Where a property is mandatory in one ancestor and optional in another, the nearer
ancestor counts, within one the mandatory; types are settled in their given order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EXTENDS, NODE

END = "struct<labels: array<string>, mandatory: array<string>, optional: array<string>>"
FLAT_EDGE = f"struct<rel_type: string, mandatory: array<string>, optional: array<string>, src_type: string, dst_type: string, card_error: boolean, src: {END}, dst: {END}>"


def ancestors(nodes: list[dict], edges: list[dict]) -> dict[str, list[str]]:
    """Of each type, all it extends, nearest first; in a cycle a type is its own ancestor."""
    parents: dict[str, list[str]] = {}
    for e in edges:
        if e["rel_type"] == EXTENDS:
            parents.setdefault(e["src_type"], []).append(e["dst_type"])
    found = {}
    for n in nodes:
        line = list(dict.fromkeys(parents.get(n["type_id"], [])))
        for a in line:  # grows while it is walked: breadth first
            line += [p for p in dict.fromkeys(parents.get(a, [])) if p not in line]
        found[n["type_id"]] = line
    return found


def flat(nodes: list[dict], edges: list[dict]) -> tuple[list[dict], list[dict]]:
    """Node and edge types of one schema with inheritance written out, EXTENDS gone."""
    above = ancestors(nodes, edges)
    state = {n["type_id"]: (set(n["labels"]), {p: "o" for p in n["optional"]} | {p: "m" for p in n["mandatory"]}) for n in nodes}
    for child, line in above.items():
        labels, kinds = state[child]
        for a in line:
            labels |= state[a][0]
            for kind in "mo":
                for p in [p for p, k in state[a][1].items() if k == kind]:
                    kinds.setdefault(p, kind)
    ends = {k: {"labels": sorted(labels), "mandatory": sorted(p for p, x in kinds.items() if x == "m"), "optional": sorted(p for p, x in kinds.items() if x == "o")} for k, (labels, kinds) in state.items()}

    real = [e for e in edges if e["rel_type"] != EXTENDS]
    placed = [(e, e["src_type"], e["dst_type"]) for e in real]
    below: dict[str, list[str]] = {}
    for child, line in above.items():
        for a in line:
            below.setdefault(a, []).append(child)
            for e in real:
                loop = e["src_type"] == e["dst_type"]
                if not loop and e["src_type"] == a:
                    placed.append((e, child, e["dst_type"]))
                if not loop and e["dst_type"] == a:
                    placed.append((e, e["src_type"], child))
    for n in nodes:
        clan = [*below.get(n["type_id"], []), n["type_id"]]
        if len(clan) > 1:
            placed += [(e, x, y) for e in real if e["src_type"] == e["dst_type"] == n["type_id"] for x in clan for y in clan]
    seen, out = set(), []
    for e, src, dst in placed:
        key = (src, e["rel_type"], dst, tuple(sorted(e["mandatory"])), tuple(sorted(e["optional"])))
        if key not in seen:
            seen.add(key)
            out.append({"rel_type": e["rel_type"], "mandatory": list(key[3]), "optional": list(key[4]), "src_type": src, "dst_type": dst, "card_error": bool(e["card_error"]), "src": ends[src], "dst": ends[dst]})
    return [{"type_id": k, **v} for k, v in ends.items()], out


def _plain(value):
    """Arrays of pandas rows as lists, all the way down."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if hasattr(value, "__iter__") and not isinstance(value, str) else value


def flatten(schemas: DataFrame) -> DataFrame:
    """``schemas`` with flat_nodes and flat_edges; edges carry their ends' types."""
    keep = schemas.columns
    at = [f"{f.name} {f.dataType.simpleString()}" for f in schemas.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [flat(_plain(n), _plain(e)) for n, e in zip(batch["nodes"], batch["edges"], strict=True)]
            yield batch.assign(flat_nodes=[n for n, _ in pairs], flat_edges=[e for _, e in pairs])[[*keep, "flat_nodes", "flat_edges"]]

    return schemas.mapInPandas(run, ", ".join([*at, f"flat_nodes array<{NODE}>", f"flat_edges array<{FLAT_EDGE}>"]))


def without_node(node: Column) -> tuple[Column, Column]:
    """nodes and edges of a schema row without a node type and the edges at it."""
    edges = F.filter("edges", lambda e: (e["src_type"] != node) & (e["dst_type"] != node))
    return F.filter("nodes", lambda n: n["type_id"] != node), edges


def variants(schemas: DataFrame) -> DataFrame:
    """Each schema as it is (''), without each node type (n:id), and without each edge type that is no EXTENDS (e:id)."""
    base = schemas.withColumn("variant", F.lit(""))
    nodes = schemas.withColumn("_node", F.explode("nodes.type_id"))
    less, rest = without_node(F.col("_node"))
    nodes = nodes.select(*(less.alias("nodes") if c == "nodes" else rest.alias("edges") if c == "edges" else c for c in schemas.columns), F.concat(F.lit("n:"), "_node").alias("variant"))
    edges = schemas.withColumn("_edge", F.explode(F.filter("edges", lambda e: e["rel_type"] != EXTENDS)))
    kept = F.filter("edges", lambda e: e["edge_id"] != F.col("_edge.edge_id"))
    edges = edges.select(*(kept.alias("edges") if c == "edges" else c for c in schemas.columns), F.concat(F.lit("e:"), F.col("_edge.edge_id")).alias("variant"))
    return base.unionByName(nodes).unionByName(edges)


def closure(schemas: DataFrame) -> DataFrame:
    """schema_id, child, ancestor, place: the EXTENDS ancestors of every type, nearest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, c, a, k + 1) for s, n, e in zip(batch["schema_id"], batch["nodes"], batch["edges"], strict=True) for c, line in ancestors(_plain(n), _plain(e)).items() for k, a in enumerate(line)]
            yield pd.DataFrame(rows, columns=["schema_id", "child", "ancestor", "place"])

    return schemas.select("schema_id", "nodes", "edges").mapInPandas(run, "schema_id string, child string, ancestor string, place int")


