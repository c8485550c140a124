"""Schemas found from label sets and from weighted similarity.

Everything here works on type-level rows: instances have been counted away.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import weighted_jaccard
from ..model import EXTENDS
from .abstraction import edge_patterns, node_patterns


# --- label sets -------------------------------------------------------------
def label_pairs(types: DataFrame) -> DataFrame:
    """labels_a, labels_b of distinct label sets that share a label, the smaller by order first."""
    sets = types.select("labels").distinct()
    by_label = sets.select("labels", F.explode("labels").alias("l"))
    a, b = (by_label.select(F.col("labels").alias(f"labels_{x}"), "l") for x in "ab")
    return a.join(b, "l").where(F.array_join("labels_a", "\x01") < F.array_join("labels_b", "\x01")).select("labels_a", "labels_b").distinct()


def supertypes(types: DataFrame, reuse: bool = True) -> DataFrame:
    """child, parent, made: EXTENDS pairs of label sets.

    A set within another is its parent; of two others the shared labels are the
    parent of both.  A parent that is no type yet is ``made``, without properties;
    with ``reuse`` off, shared labels are always made anew.
    """
    p = label_pairs(types).withColumn("shared", F.array_intersect("labels_a", "labels_b"))
    inside = lambda small, big: p.where(F.size("shared") == F.size(small)).where(F.size(small) < F.size(big)).select(F.col(big).alias("child"), F.col(small).alias("parent"), F.lit(False).alias("made"))
    cross = p.where((F.size("shared") < F.size("labels_a")) & (F.size("shared") < F.size("labels_b")))
    both = cross.select(F.explode(F.array("labels_a", "labels_b")).alias("child"), F.array_sort("shared").alias("parent"))
    known = types.select(F.col("labels").alias("parent")).distinct().withColumn("known", F.lit(True))
    both = both.join(known, "parent", "left").select("child", "parent", (F.col("known").isNull() | F.lit(not reuse)).alias("made"))
    return inside("labels_a", "labels_b").unionByName(inside("labels_b", "labels_a")).unionByName(both).distinct()


def strip_inherited(types: DataFrame, parents: DataFrame) -> DataFrame:
    """labels, own_labels, own_props: without what any parent has, judged on the types as they were."""
    props = types.select("labels", F.array_sort(F.array_union("mandatory", "optional")).alias("props"))
    above = parents.join(props.withColumnRenamed("labels", "parent").withColumnRenamed("props", "parent_props"), "parent", "left")
    none = F.array().cast("array<string>")
    above = above.groupBy(F.col("child").alias("labels")).agg(F.array_distinct(F.flatten(F.collect_list("parent"))).alias("up_labels"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("parent_props", none)))).alias("up_props"))
    return props.join(above, "labels", "left").select("labels", F.array_except("labels", F.coalesce("up_labels", none)).alias("own_labels"), F.array_except("props", F.coalesce("up_props", none)).alias("own_props"))


def label_set_schema(types: DataFrame, edge_rows: DataFrame, name: str = "label_sets") -> DataFrame:
    """The schema row of label-set discovery: a node type a set, made parents, EXTENDS, edge types."""
    up = supertypes(types)
    made = up.where("made").select(F.col("parent").alias("labels")).distinct()
    none = F.array().cast("array<string>")
    nodes = types.select("labels", "mandatory", "optional").unionByName(made.select("labels", none.alias("mandatory"), none.alias("optional")))
    node = nodes.select(F.struct(type_name(F.col("labels")).alias("type_id"), "labels", "mandatory", "optional").alias("t"))
    edge = edge_rows.select(F.struct(F.concat_ws("|", type_name(F.col("src_labels")), "rel_type", type_name(F.col("dst_labels"))).alias("edge_id"), "rel_type", "mandatory", "optional", type_name(F.col("src_labels")).alias("src_type"), type_name(F.col("dst_labels")).alias("dst_type"), F.lit(False).alias("card_error")).alias("t"))
    child = up.select(F.struct(F.concat_ws("|", type_name(F.col("child")), F.lit(EXTENDS), type_name(F.col("parent"))).alias("edge_id"), F.lit(EXTENDS).alias("rel_type"), none.alias("mandatory"), none.alias("optional"), type_name(F.col("child")).alias("src_type"), type_name(F.col("parent")).alias("dst_type"), F.lit(False).alias("card_error")).alias("t"))
    return schema_row(node, edge.unionByName(child), name)


def type_name(labels: Column) -> Column:
    return F.array_join(labels, ":")


def schema_row(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One schema row of type-level rows (t: the struct of a type)."""
    n = nodes.agg(F.array_sort(F.collect_list("t")).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list("t")).alias("edges"))
    return n.join(F.broadcast(e)).select(F.lit(name).alias("schema_id"), "nodes", "edges")  # one row each


# --- weighted similarity ----------------------------------------------------
def frequency_map(frequency: DataFrame, kind: str) -> DataFrame:
    """One row with a map from name to its number of types."""
    return frequency.where(F.col("kind") == kind).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias(f"{kind}_n"))


def type_similarities(types: DataFrame, frequency: DataFrame, label_w: float = 1.0, prop_w: float = 0.0) -> DataFrame:
    """a, b, similarity of pairs a < b of types (type_id, labels, keys): weighted Jaccards, weights normalised.

    Types are distinct structures, few beside the instance; pairs without a shared
    label or key are 0 unless both sides are empty, so pairs are made on shared
    words and on emptiness only.
    """
    total = label_w + prop_w
    words = F.concat(F.transform("labels", lambda x: F.concat(F.lit("l:"), x)), F.transform("keys", lambda x: F.concat(F.lit("p:"), x)), F.when(F.size("labels") == 0, F.array(F.lit("l"))).otherwise(F.array()), F.when(F.size("keys") == 0, F.array(F.lit("p"))).otherwise(F.array()))
    named = types.select("type_id", "labels", "keys").select("*", F.explode(words).alias("word"))
    a, b = (named.select(F.col("type_id").alias(x), F.struct("labels", "keys").alias(f"{x}_t"), "word") for x in "ab")
    pairs = a.join(b, "word").where("a < b").drop("word").dropDuplicates(["a", "b"])
    pairs = pairs.join(F.broadcast(frequency_map(frequency, "label"))).join(F.broadcast(frequency_map(frequency, "prop")))  # one row each
    value = (label_w * weighted_jaccard(F.col("a_t.labels"), F.col("b_t.labels"), F.col("label_n")) + prop_w * weighted_jaccard(F.col("a_t.keys"), F.col("b_t.keys"), F.col("prop_n"))) / total
    return pairs.select("a", "b", value.alias("similarity"))


def _best_mean(pairs: DataFrame, of: str, n: str) -> DataFrame:
    """Mean over one side's signatures of their best match on the other."""
    best = pairs.groupBy("a", "b", of, n).agg(F.max("s").alias("s"))
    return best.groupBy("a", "b").agg((F.sum("s") / F.max(n)).alias("m"))


def topology_similarities(types: DataFrame) -> DataFrame:
    """a, b, similarity of node types (type_id, incoming, outgoing) by their edge signatures.

    In each direction the smaller of both sides' mean best match, 0 if one side has
    no signature; then the mean of both directions.  Signatures are type:key,key;
    a match is the mean of equal types and of the keys' Jaccard.
    """
    def direction(side: str) -> DataFrame:
        sigs = types.where(F.size(side) > 0).select("type_id", F.size(side).alias("n"), F.explode(side).alias("sig"))
        parts = F.split("sig", ":", 2)
        sigs = sigs.select("type_id", "n", "sig", parts[0].alias("rel"), F.filter(F.split(F.coalesce(parts[1], F.lit("")), ","), lambda x: x != "").alias("keys"))
        a, b = (sigs.select(*(F.col(c).alias(f"{c}_{x}" if c != "type_id" else x) for c in sigs.columns)) for x in "ab")
        pairs = a.join(b, F.col("rel_a") == F.col("rel_b")).where("a < b")
        union = F.size(F.array_union("keys_a", "keys_b"))
        pairs = pairs.withColumn("s", F.when(union == 0, F.lit(1.0)).otherwise(0.5 + 0.5 * F.size(F.array_intersect("keys_a", "keys_b")) / union))
        one, two = _best_mean(pairs, "sig_a", "n_a"), _best_mean(pairs, "sig_b", "n_b")
        return one.join(two.withColumnRenamed("m", "m2"), ["a", "b"]).select("a", "b", F.least("m", "m2").alias("s"))

    both = direction("incoming").unionByName(direction("outgoing"))
    return both.groupBy("a", "b").agg((F.sum("s") / 2.0).alias("similarity"))


def edge_topology_similarities(types: DataFrame, frequency: DataFrame) -> DataFrame:
    """a, b, similarity of edge types (type_id, rel_type and both ends' labels and keys): the mean of four weighted Jaccards."""
    cols = ("src_labels", "src_keys", "dst_labels", "dst_keys")
    a, b = (types.select(F.col("type_id").alias(x), F.struct(*cols).alias(f"{x}_t"), F.col("rel_type").alias("r")) for x in "ab")
    pairs = a.join(b, "r").where("a < b").join(F.broadcast(frequency_map(frequency, "label"))).join(F.broadcast(frequency_map(frequency, "prop")))  # one row each
    parts = [weighted_jaccard(F.col(f"a_t.{c}"), F.col(f"b_t.{c}"), F.col("label_n" if "labels" in c else "prop_n")) for c in cols]
    return pairs.select("a", "b", (sum(parts[1:], parts[0]) / 4.0).alias("similarity"))


def greedy_partition(types: DataFrame, similarities: DataFrame, theta: float = 0.5) -> DataFrame:
    """type_id, part: each type, in order of ids, joins the first part with a member at least theta similar.

    First fit is sequential by definition; it runs as one group over type-level rows.
    """
    near = similarities.where(F.col("similarity") >= theta)
    both = near.select(F.col("a").alias("type_id"), F.col("b").alias("o")).unionByName(near.select(F.col("b").alias("type_id"), F.col("a").alias("o")))
    rows = types.select("type_id").join(both.groupBy("type_id").agg(F.collect_set("o").alias("near")), "type_id", "left").withColumn("g", F.lit(0))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        part: dict[str, int] = {}
        n = 0
        for t, others in sorted(zip(group["type_id"], group["near"], strict=True), key=lambda x: x[0]):
            met = [part[o] for o in (others if others is not None else ()) if o in part]
            part[t] = min(met) if met else n
            n += not met
        return pd.DataFrame({"type_id": list(part), "part": list(part.values())})

    return rows.groupBy("g").applyInPandas(fit, "type_id string, part int")


def partition_types(types: DataFrame, parts: DataFrame) -> DataFrame:
    """part, labels (all members'), mandatory (keys that all members have), optional (the rest)."""
    rows = types.join(parts, "type_id")
    n = rows.groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
    keys = rows.select("part", F.explode("keys").alias("k")).groupBy("part", "k").agg(F.count("*").alias("c")).join(n.select("part", "n"), "part")
    none = F.array().cast("array<string>")
    split = keys.groupBy("part").agg(F.array_sort(F.collect_list(F.when(F.col("c") == F.col("n"), F.col("k")))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("c") < F.col("n"), F.col("k")))).alias("o"))
    return n.join(split, "part", "left").select("part", "labels", F.coalesce("m", none).alias("mandatory"), F.coalesce("o", none).alias("optional"))


def key_set_types(nodes: DataFrame) -> DataFrame:
    """type_id, labels, keys, n: distinct (label set, key set)."""
    name = F.concat_ws("|", F.array_join("labels", ":"), F.array_join("keys", ","))
    return node_patterns(nodes).select(name.alias("type_id"), "labels", "keys", "n")


def edge_key_set_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """type_id, labels (the type's name alone), src_labels, dst_labels, keys, n: distinct (type, end labels, key set)."""
    name = F.concat_ws("|", "rel_type", F.array_join("src_labels", ":"), F.array_join("dst_labels", ":"), F.array_join("keys", ","))
    return edge_patterns(edges, nodes).select(name.alias("type_id"), F.array("rel_type").alias("labels"), "src_labels", "dst_labels", "keys", "n")


def partition_edge_types(types: DataFrame, parts: DataFrame) -> DataFrame:
    """part, rel_type, src_labels, dst_labels, mandatory, optional: a row for each type and ends in a part, with the keys of the whole part."""
    members = types.join(parts, "type_id").select("part", F.col("labels")[0].alias("rel_type"), "src_labels", "dst_labels").distinct()
    return members.join(partition_types(types, parts).drop("labels"), "part")


def attach_edges(edge_types: DataFrame, node_types: DataFrame) -> DataFrame:
    """Edge types of which both ends are the exact label set of a node type, each once; the others attach to nothing."""
    sets = node_types.select("labels").distinct()
    found = edge_types.distinct()
    for end in ("src_labels", "dst_labels"):
        found = found.join(sets.withColumnRenamed("labels", end), end, "left_semi")
    return found


def edges_by_strings(triples: DataFrame, types: DataFrame) -> DataFrame:
    """src, rel_type, dst of types (id, labels, properties) whose helper strings equal a triple's.

    Triples have src_labels, src_properties, rel_type, dst_labels and dst_properties
    as strings; a ``?`` in source labels is left out before the comparison.
    """
    end = lambda p: types.select(F.col("id").alias(p), F.col("labels").alias(f"{p}_labels"), F.col("properties").alias(f"{p}_properties"))
    rows = triples.withColumn("src_labels", F.replace("src_labels", F.lit("?"), F.lit("")))
    for p in ("src", "dst"):
        rows = rows.join(end(p), [f"{p}_labels", f"{p}_properties"])
    return rows.select("src", "rel_type", "dst").distinct()


# --- merging clusters -------------------------------------------------------
def merge_by_labels(clusters: DataFrame) -> DataFrame:
    """labels, members, mandatory, optional of clusters (cluster_id, labels, keys, n) with one label set.

    A key is mandatory if every cluster's members all have it: by counts, exact.
    """
    total = clusters.groupBy("labels").agg(F.sum("n").alias("members"), F.count_distinct("cluster_id").alias("clusters"))
    keys = clusters.select("labels", "n", F.explode("keys").alias("k")).groupBy("labels", "k").agg(F.sum("n").alias("c")).join(total.select("labels", "members"), "labels")
    none = F.array().cast("array<string>")
    split = keys.groupBy("labels").agg(F.array_sort(F.collect_list(F.when(F.col("c") == F.col("members"), F.col("k")))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("c") < F.col("members"), F.col("k")))).alias("o"))
    return total.join(split, "labels", "left").select("labels", "members", "clusters", F.coalesce("m", none).alias("mandatory"), F.coalesce("o", none).alias("optional"))


def match_unlabelled(types: DataFrame, threshold: float = 0.9) -> DataFrame:
    """type_id, match, similarity: for types without labels the labelled type of the most similar keys.

    Pairs are made on shared keys only; Jaccard follows from the counts.
    """
    keyed = types.select("type_id", "labels", F.size("keys").alias("k"), F.explode("keys").alias("key"))
    bare, named = keyed.where(F.size("labels") == 0), keyed.where(F.size("labels") > 0)
    a = bare.select(F.col("type_id"), F.col("k").alias("ka"), "key")
    b = named.select(F.col("type_id").alias("match"), F.col("k").alias("kb"), "key")
    common = a.join(b, "key").groupBy("type_id", "match", "ka", "kb").agg(F.count("*").alias("c"))
    found = common.withColumn("similarity", F.col("c") / (F.col("ka") + F.col("kb") - F.col("c"))).where(F.col("similarity") >= threshold)
    best = F.row_number().over(Window.partitionBy("type_id").orderBy(F.desc("similarity"), "match"))
    return found.withColumn("r", best).where("r = 1").select("type_id", "match", "similarity")


def unmatched(types: DataFrame, matches: DataFrame) -> DataFrame:
    """Unlabelled types that nothing matched: they become abstract types."""
    return types.where(F.size("labels") == 0).join(matches, "type_id", "left_anti")


def similar_label_sets(types: DataFrame, threshold: float) -> DataFrame:
    """labels_a, labels_b, similarity of label sets whose Jaccard reaches the threshold."""
    value = F.size(F.array_intersect("labels_a", "labels_b")) / F.size(F.array_union("labels_a", "labels_b"))
    return label_pairs(types).withColumn("similarity", value).where(F.col("similarity") >= threshold)
