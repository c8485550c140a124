"""The data model: instance graphs, schema graphs, and canonical forms.

An instance graph is two tables::

    nodes(node_id, labels array<string>, props map<string, string>)
    edges(edge_id, src, dst, rel_type, props map<string, string>)

A schema is a row (schema_id, nodes, edges) whose arrays hold its types; an edge
type's ends name node types.  Schemas stay rows so that thousands of candidates,
or variants of one, are scored in a single plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<type_id: string, labels: array<string>, mandatory: array<string>, optional: array<string>>"
EDGE = "struct<edge_id: string, rel_type: string, mandatory: array<string>, optional: array<string>, src_type: string, dst_type: string, card_error: boolean>"
SCHEMA = f"schema_id string, nodes array<{NODE}>, edges array<{EDGE}>"
#: The relationship type by which a schema node inherits from another.
EXTENDS = "EXTENDS"
#: Reserved keys of schema graphs: a copy's source id, and the mark of a wrong cardinality.
SOURCE_ID, CARDINALITY_ERROR = "__src_id", "cardinality_error"


def canonical(names: Column) -> Column:
    """Names without nulls, blanks and repeats, in order."""
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != ""))))


def present(props: Column) -> Column:
    """The keys of properties that have a value, in order: null is absence."""
    return F.array_sort(F.map_keys(F.map_filter(props, lambda _, v: v.isNotNull())))


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", canonical(F.col("labels")).alias("labels"), F.map_filter("props", lambda _, v: v.isNotNull()).alias("props"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", "src", "dst", "rel_type", F.map_filter("props", lambda _, v: v.isNotNull()).alias("props"))


@dataclass
class Schema:
    """A schema written in Python; ``a?`` among properties is an optional one."""

    name: str
    nodes: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    edges: list[tuple] = field(default_factory=list)  # (id, rel_type, src, dst, [properties], card_error = False)

    @staticmethod
    def split(props: list[str]) -> tuple[list[str], list[str]]:
        return sorted({p for p in props if not p.endswith("?")}), sorted({p[:-1] for p in props if p.endswith("?")})

    def row(self) -> tuple:
        nodes = [(k, sorted(set(labels)), *self.split(props)) for k, (labels, props) in self.nodes.items()]
        edges = []
        for e in self.edges:
            if e[2] not in self.nodes or e[3] not in self.nodes:
                raise ValueError(f"edge type {e[0]} of {self.name} has an end that is no node type")
            edges.append((e[0], e[1], *self.split(e[4]), e[2], e[3], bool(e[5]) if len(e) > 5 else False))
        return (self.name, nodes, edges)


def schemas(spark: SparkSession, *given: Schema) -> DataFrame:
    return spark.createDataFrame([s.row() for s in given], SCHEMA)


def joined(names: Column, by: str = ",") -> Column:
    return F.array_join(names, by)
