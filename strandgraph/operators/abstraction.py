"""Instance graphs to node and edge types.

All of these count first by (labels, key set): a graph has few such patterns, so
one hash aggregation with map-side combining shrinks it to type-level rows before
anything is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sig
from ..model import present
from .patterns import end_labels, of_type, with_label


def node_patterns(nodes: DataFrame) -> DataFrame:
    """labels, keys, n: how many nodes have this label set and key set."""
    return nodes.groupBy("labels", present(F.col("props")).alias("keys")).agg(F.count("*").alias("n"))


def edge_patterns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_labels, rel_type, dst_labels, keys, n."""
    slim = edges.select("src", "dst", "rel_type", present(F.col("props")).alias("keys"))
    return end_labels(slim, nodes).groupBy("src_labels", "rel_type", "dst_labels", "keys").agg(F.count("*").alias("n"))


def split_counts(counts: DataFrame, key: list[str]) -> DataFrame:
    """key..., n, mandatory, optional from counts (key..., k, n), where k = '' counts the whole type.

    One aggregation, no join: a type's few keys meet in one row and are split there.
    """
    whole = F.max(F.when(F.col("k") == "", F.col("n")))
    rows = counts.groupBy(*key).agg(whole.alias("n"), F.collect_list(F.when(F.col("k") != "", F.struct("k", F.col("n").alias("c")))).alias("ks"))
    chosen = lambda test: F.array_sort(F.transform(F.filter("ks", test), lambda x: x["k"]))
    return rows.select(*key, "n", chosen(lambda x: x["c"] == F.col("n")).alias("mandatory"), chosen(lambda x: x["c"] < F.col("n")).alias("optional"))


def _types(patterns: DataFrame, key: list[str]) -> DataFrame:
    """key..., n, mandatory, optional: a key is mandatory if all of a type have it."""
    by_key = patterns.select(*key, "n", F.explode(F.concat(F.array(F.lit("")), "keys")).alias("k")).groupBy(*key, "k").agg(F.sum("n").alias("n"))
    return split_counts(by_key, key)


def node_types(nodes: DataFrame) -> DataFrame:
    """labels, n, mandatory, optional: a row a label set; sets without a property stay."""
    return _types(node_patterns(nodes), ["labels"])


def edge_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_labels, rel_type, dst_labels, n, mandatory, optional."""
    return _types(edge_patterns(edges, nodes), ["src_labels", "rel_type", "dst_labels"])


def instance_types(nodes: DataFrame, edges: DataFrame, unlabelled: str = "compat") -> tuple[DataFrame, DataFrame]:
    """The types to score a schema against; edge types carry their ends' node types.

    With ``compat`` a node without labels has the one label '', which no schema type
    has, as scoring has it; with ``fixed`` its label set is empty.
    """
    def own(c: Column) -> Column:
        return F.when(F.size(c) == 0, F.array(F.lit(""))).otherwise(c) if unlabelled == "compat" else c

    found = node_types(nodes)
    slim = lambda p: found.select(F.col("labels").alias(f"{p}_labels"), F.struct(own(F.col("labels")).alias("labels"), "mandatory", "optional").alias(p))
    edge_rows = edge_types(edges, nodes).join(slim("src"), "src_labels").join(slim("dst"), "dst_labels")
    node_rows = found.select(sig("labels").alias("i_id"), own(F.col("labels")).alias("labels"), "mandatory", "optional", "n")
    return node_rows, edge_rows.select(sig("src_labels", "rel_type", "dst_labels").alias("i_id"), "rel_type", "mandatory", "optional", "src", "dst", "n")


def label_profile(nodes: DataFrame, label: str) -> DataFrame:
    """key, n, total, mandatory: over all nodes that have the label, among others."""
    patterns = node_patterns(with_label(nodes, label))
    total = patterns.agg(F.sum("n").alias("total"))
    keys = patterns.select("n", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("n").alias("n"))
    return keys.join(F.broadcast(total)).select("key", "n", "total", (F.col("n") == F.col("total")).alias("mandatory"))  # one row


def type_profile(edges: DataFrame, rel_type: str) -> DataFrame:
    """key, n, total, mandatory: over all edges of the relationship type."""
    patterns = of_type(edges, rel_type).groupBy(present(F.col("props")).alias("keys")).agg(F.count("*").alias("n"))
    total = patterns.agg(F.sum("n").alias("total"))
    keys = patterns.select("n", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("n").alias("n"))
    return keys.join(F.broadcast(total)).select("key", "n", "total", (F.col("n") == F.col("total")).alias("mandatory"))  # one row


def json_kind(value: Column) -> Column:
    """The kind a JSON round trip would give a value."""
    v = F.trim(value)
    return (
        F.when(v.rlike("^-?(0|[1-9][0-9]*)$"), "int").when(v.rlike("^-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float")
        .when(F.lower(v).isin("true", "false"), "bool").otherwise("str")
    )


def property_kinds(nodes: DataFrame) -> DataFrame:
    """labels, key, kinds (joined by +), n, optional, by the rule of the most frequent key.

    A key is optional if its count is not the largest count of any key of its label
    set; so the most frequent key counts as mandatory even if some nodes lack it.
    """
    values = nodes.select("labels", F.explode("props").alias("key", "value")).where("value is not null")
    by_kind = values.groupBy("labels", "key", json_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
    by_key = by_kind.groupBy("labels", "key").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy("labels"))
    return by_key.withColumn("optional", F.col("n") != most)


def structural_node_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (labels, keys, incoming, outgoing): signatures are relationship types with their keys."""
    slim = edges.select("src", "dst", F.concat_ws(":", F.col("rel_type"), F.array_join(present(F.col("props")), ",")).alias("sig"))
    side = lambda end, name: slim.select(F.col(end).alias("node_id"), "sig").groupBy("node_id").agg(F.array_sort(F.collect_set("sig")).alias(name))
    none = F.array().cast("array<string>")
    rows = nodes.select("node_id", "labels", present(F.col("props")).alias("keys")).join(side("dst", "incoming"), "node_id", "left").join(side("src", "outgoing"), "node_id", "left")
    return rows.groupBy("labels", "keys", F.coalesce("incoming", none).alias("incoming"), F.coalesce("outgoing", none).alias("outgoing")).agg(F.count("*").alias("n"))


def structural_edge_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (type, keys, labels and keys of both ends)."""
    ends = lambda p: nodes.select(F.col("node_id").alias(p), F.col("labels").alias(f"{p}_labels"), present(F.col("props")).alias(f"{p}_keys"))
    slim = edges.select("src", "dst", "rel_type", present(F.col("props")).alias("keys"))
    return slim.join(ends("src"), "src").join(ends("dst"), "dst").groupBy("rel_type", "keys", "src_labels", "src_keys", "dst_labels", "dst_keys").agg(F.count("*").alias("n"))


def attribute_frequency(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """kind (label or prop), name, n: over distinct structural types, nodes' and edges' together."""
    n, e = node_rows.select("labels", "keys"), edge_rows.select(F.array("rel_type").alias("labels"), "keys")
    both = n.unionByName(e)
    labels = both.select(F.lit("label").alias("kind"), F.explode("labels").alias("name"))
    props = both.select(F.lit("prop").alias("kind"), F.explode("keys").alias("name"))
    return labels.unionByName(props).groupBy("kind", "name").agg(F.count("*").alias("n"))


def ranked_words(nodes: DataFrame) -> DataFrame:
    """kind, word, n, place: labels and keys by how many nodes have them, ties by name."""
    patterns = node_patterns(nodes)
    words = patterns.select("n", F.lit("label").alias("kind"), F.explode("labels").alias("word")).unionByName(patterns.select("n", F.lit("prop").alias("kind"), F.explode("keys").alias("word")))
    counts = words.groupBy("kind", "word").agg(F.sum("n").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "word")))
