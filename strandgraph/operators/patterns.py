"""Graph patterns as filters and equi-joins.

Patterns name what a graph query language would match: labels, exact label sets,
relationship types, property tests, ends, and paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import canonical


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes that have the label, among others."""
    return nodes.where(F.array_contains("labels", label))


def with_label_set(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes that have just these labels."""
    return nodes.where(F.col("labels") == F.array_sort(F.array(*map(F.lit, sorted(set(labels))))))


def of_type(edges: DataFrame, rel_type: str) -> DataFrame:
    return edges.where(F.col("rel_type") == rel_type)


def has_property(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("props")[key].isNotNull())


def property_is(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col("props")[key] == value)


def optional_mark(value: Column) -> Column:
    """Whether a schema graph's property value marks an optional property; null does not."""
    return F.coalesce(F.endswith(value, F.lit("?")), F.lit(False))


def presence(props: Column, keys: list[str]) -> Column:
    """1.0 or 0.0 for each key."""
    return F.array(*(F.when(props[k].isNotNull(), 1.0).otherwise(0.0) for k in keys))


def expand(edges: DataFrame, nodes: DataFrame, optional: bool = False) -> DataFrame:
    """Edges with src_labels, src_props, dst_labels, dst_props; ``optional`` keeps edges whose ends are missing."""
    how = "left" if optional else "inner"
    ends = lambda p: nodes.select(F.col("node_id").alias(p), F.col("labels").alias(f"{p}_labels"), F.col("props").alias(f"{p}_props"))
    return edges.join(ends("src"), "src", how).join(ends("dst"), "dst", how)


def end_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the label sets of their ends; properties of nodes are not read."""
    ends = lambda p: nodes.select(F.col("node_id").alias(p), F.col("labels").alias(f"{p}_labels"))
    return edges.join(ends("src"), "src").join(ends("dst"), "dst")


def match(edges: DataFrame, nodes: DataFrame, src: str, rel_type: str | None, dst: str) -> DataFrame:
    """Edges (:src)-[:rel_type]->(:dst)."""
    chosen = edges if rel_type is None else of_type(edges, rel_type)
    return expand(chosen, nodes).where(F.array_contains("src_labels", src) & F.array_contains("dst_labels", dst))


def distinct_source_labels(edges: DataFrame, nodes: DataFrame, rel_type: str) -> DataFrame:
    ends = nodes.select(F.col("node_id").alias("src"), "labels")
    return of_type(edges, rel_type).join(ends, "src").select("labels").distinct()


def two_hops(edges: DataFrame, nodes: DataFrame, first: tuple[str, str, str], second: tuple[str, str]) -> DataFrame:
    """start, middle, end of paths (:a)-[:r]->(:b)-[:s]->(:c)."""
    a, r, b = first
    s, c = second
    ids = lambda label, name: with_label(nodes, label).select(F.col("node_id").alias(name))
    one = of_type(edges, r).select(F.col("src").alias("start"), F.col("dst").alias("middle"))
    two = of_type(edges, s).select(F.col("src").alias("middle"), F.col("dst").alias("end"))
    return one.join(ids(a, "start"), "start").join(ids(b, "middle"), "middle").join(two, "middle").join(ids(c, "end"), "end").select("start", "middle", "end")


def optional_degree(nodes: DataFrame, edges: DataFrame, label: str, rel_type: str) -> DataFrame:
    """Every node of the label with its number of outgoing edges of the type, 0 for none."""
    out = of_type(edges, rel_type).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return with_label(nodes, label).join(out, "node_id", "left").select("node_id", "labels", F.coalesce("degree", F.lit(0)).alias("degree"))


def pages(rows: DataFrame, key: str, size: int, within: str | None = None) -> DataFrame:
    """``rows`` with page, the number of its page of ``size`` rows in order of the key.

    Positions come from counts by a hash-free range prefix (``within``, a column such
    as the kind of id) so that no single task orders the whole table; without one, ids
    are counted by the first characters of the key.
    """
    prefix = F.col(within) if within else F.substring(F.col(key).cast("string"), 1, 8)
    named = rows.withColumn("_prefix", prefix)
    counts = named.groupBy("_prefix").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_prefix").orderBy(key)) - 1
    placed = named.withColumn("_own", own).join(starts, "_prefix")
    return placed.withColumn("page", F.floor((F.col("_start") + F.col("_own")) / size)).drop("_prefix", "_own", "_start")


def aligned_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def relabelled(labels: Column) -> Column:
    return canonical(labels)
