"""Coverage, concision, their harmonic mean, and exact-match F1.

All schemas and all their leave-one-out variants are scored in one plan: types
are joined on labels (nodes) or relationship types (edges), so that pairs whose
similarity is 0 are never made, and best matches are kept by plain aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import Weights, edge_similarity, harmonic, node_similarity
from ..model import EXTENDS
from .flatten import flatten, variants

KEY = ["schema_id", "variant"]


def node_pairs(flat: DataFrame, inst_nodes: DataFrame, w: Weights) -> DataFrame:
    """key..., i_id, type_id, similarity of all pairs whose labels overlap."""
    schema = flat.select(*KEY, F.explode("flat_nodes").alias("s"))
    by_label = schema.select("*", F.explode("s.labels").alias("label"))
    mine = inst_nodes.select("i_id", F.struct("labels", "mandatory", "optional").alias("i"), F.explode("labels").alias("label"))
    met = by_label.join(mine, "label").select(*KEY, "i_id", F.col("s.type_id").alias("type_id"), node_similarity(F.col("i"), F.col("s"), w).alias("similarity"))
    return met.groupBy(*KEY, "i_id", "type_id").agg(F.max("similarity").alias("similarity"))


def edge_pairs(flat: DataFrame, inst_edges: DataFrame, w: Weights) -> DataFrame:
    """key..., i_id, col (place among the flat edge types), similarity of pairs of one type with overlapping ends."""
    schema = flat.select(*KEY, F.posexplode("flat_edges").alias("col", "s")).withColumn("rel_type", F.col("s.rel_type"))
    mine = inst_edges.select("i_id", "rel_type", F.struct("rel_type", "mandatory", "optional", "src", "dst").alias("i"))
    ends = F.arrays_overlap(F.col("s.src.labels"), F.col("i.src.labels")) & F.arrays_overlap(F.col("s.dst.labels"), F.col("i.dst.labels"))
    return schema.join(mine, "rel_type").where(ends).select(*KEY, "i_id", "col", edge_similarity(F.col("i"), F.col("s"), w).alias("similarity"))


def coverage(total: Column, n_instance: Column, n_schema: Column, strict: bool = False) -> Column:
    """Mean best similarity. Without schema types 0, or 1 if there is nothing to cover either; ``strict``: 0."""
    empty = F.lit(0.0) if strict else F.when(n_instance > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(n_schema == 0, empty).when(n_instance == 0, F.lit(1.0)).otherwise(F.coalesce(total, F.lit(0.0)) / n_instance)


def coverages(flat: DataFrame, inst_nodes: DataFrame, inst_edges: DataFrame, w: Weights) -> DataFrame:
    """key..., node_cov, edge_cov, strict ones, and the numbers of types."""
    best = lambda pairs: pairs.groupBy(*KEY, "i_id").agg(F.max("similarity").alias("b")).groupBy(*KEY).agg(F.sum("b").alias("total"))
    nodes = best(node_pairs(flat, inst_nodes, w)).withColumnRenamed("total", "node_total")
    edges = best(edge_pairs(flat, inst_edges, w)).withColumnRenamed("total", "edge_total")
    sizes = inst_nodes.agg(F.count("*").alias("i_nodes")).join(F.broadcast(inst_edges.agg(F.count("*").alias("i_edges"))))  # one row
    own = flat.select(*KEY, F.size("flat_nodes").alias("s_nodes"), F.size("flat_edges").alias("s_edges"))
    rows = own.join(nodes, KEY, "left").join(edges, KEY, "left").join(F.broadcast(sizes))
    c = F.col
    return rows.select(
        *KEY, "i_nodes", "i_edges", "s_nodes", "s_edges",
        coverage(c("node_total"), c("i_nodes"), c("s_nodes")).alias("node_cov"), coverage(c("edge_total"), c("i_edges"), c("s_edges")).alias("edge_cov"),
        coverage(c("node_total"), c("i_nodes"), c("s_nodes"), True).alias("node_cov0"), coverage(c("edge_total"), c("i_edges"), c("s_edges"), True).alias("edge_cov0"),
    )


def score(schemas: DataFrame, inst_nodes: DataFrame, inst_edges: DataFrame, w: Weights = Weights()) -> DataFrame:
    """schema_id and node and edge coverage, concision and their harmonic mean (C2).

    A type is redundant if the schema without it loses less coverage than gamma
    times an average type's share, of nodes and of edges (strictly less, so that
    nothing is redundant where there is no coverage).  Without EXTENDS, edge types
    that share ends and relationship type are redundant.
    """
    inst_nodes, inst_edges = inst_nodes.cache(), inst_edges.cache()  # types, not instances
    cov = coverages(flatten(variants(schemas)), inst_nodes, inst_edges, w)
    base = cov.where("variant = ''").select("schema_id", *(F.col(c).alias(f"base_{c}") for c in ("node_cov", "edge_cov", "s_edges", "i_nodes", "i_edges")))
    stars = schemas.select("schema_id", F.size("nodes").alias("n_star"), F.size("edges").alias("e_star"), F.exists("edges", lambda e: e["rel_type"] == EXTENDS).alias("extends"))
    base = base.join(stars, "schema_id")
    same = lambda e, o: (e["src_type"] == o["src_type"]) & (e["rel_type"] == o["rel_type"]) & (e["dst_type"] == o["dst_type"])
    twins = F.filter("edges", lambda e: F.size(F.filter(F.col("edges"), lambda o: same(e, o))) > 1)
    twins = schemas.select("schema_id", F.explode(F.transform(twins, lambda e: F.concat(F.lit("e:"), e["edge_id"]))).alias("variant"), F.lit(True).alias("twin"))

    c = F.col
    rows = cov.where("variant <> ''").join(base, "schema_id").join(twins, ["schema_id", "variant"], "left")
    node_theta = w.gamma * c("base_node_cov") / F.greatest(c("n_star"), F.lit(1))
    edge_theta = F.when(c("base_s_edges") == 0, F.lit(1.0)).otherwise(w.gamma * c("base_edge_cov") / F.greatest(c("base_s_edges"), F.lit(1)))
    edge_small = c("base_edge_cov") - c("edge_cov0") < edge_theta
    of_node = F.startswith("variant", F.lit("n:"))
    node_redundant = (c("base_node_cov") - c("node_cov0") < node_theta) & edge_small
    edge_redundant = F.when(c("extends"), (c("base_node_cov") - c("node_cov") < node_theta) & edge_small).otherwise(F.coalesce("twin", F.lit(False)) | edge_small)
    counts = rows.groupBy("schema_id").agg(
        F.sum((of_node & node_redundant).cast("int")).alias("node_redundant"), F.sum((~of_node & edge_redundant).cast("int")).alias("edge_redundant"),
        F.sum((~of_node).cast("int")).alias("e_candidates"),
    )
    rows = base.join(counts, "schema_id", "left")
    node_con = F.when(c("n_star") == 0, F.lit(1.0)).when(c("base_i_nodes") == 0, F.lit(0.0)).otherwise(1.0 - c("node_redundant") / c("n_star"))
    flat_none = ~c("extends") & (c("base_s_edges") == 0)
    edge_con = F.when((c("e_star") == 0), F.lit(1.0)).when(c("base_i_edges") == 0, F.lit(0.0)).when(flat_none | (F.coalesce("e_candidates", F.lit(0)) == 0), F.lit(1.0)).otherwise(1.0 - c("edge_redundant") / c("e_candidates"))
    rows = rows.select("schema_id", c("base_node_cov").alias("node_coverage"), c("base_edge_cov").alias("edge_coverage"), node_con.alias("node_concision"), edge_con.alias("edge_concision"))
    return rows.withColumn("node_c2", harmonic(c("node_coverage"), c("node_concision"))).withColumn("edge_c2", harmonic(c("edge_coverage"), c("edge_concision")))


def edge_concision_top2(schemas: DataFrame, inst_nodes: DataFrame, inst_edges: DataFrame, w: Weights = Weights()) -> DataFrame:
    """schema_id, edge_concision of schemas without EXTENDS, without any variant.

    Deleting a type changes only the instance types that it alone fits best, and
    those fall back to their second best: one window gives all losses.
    """
    flat = flatten(schemas.where(~F.exists("edges", lambda e: e["rel_type"] == EXTENDS)).withColumn("variant", F.lit("")))
    pairs = edge_pairs(flat, inst_edges, w)
    ranked = F.row_number().over(Window.partitionBy(*KEY, "i_id").orderBy(F.desc("similarity"), "col"))
    top = pairs.withColumn("r", ranked).where("r <= 2").groupBy("schema_id", "i_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("similarity"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("similarity"))).alias("second"), F.max(F.when(F.col("r") == 1, F.col("col"))).alias("col")
    )
    n = F.broadcast(inst_edges.agg(F.count("*").alias("n")))  # one row
    total = top.groupBy("schema_id").agg(F.sum("best").alias("total"))
    losses = top.groupBy("schema_id", "col").agg(F.sum(F.col("best") - F.coalesce("second", F.lit(0.0))).alias("loss"))
    columns = flat.select("schema_id", F.size("flat_edges").alias("n_flat"), F.posexplode("flat_edges").alias("col", "e"))
    columns = columns.join(losses, ["schema_id", "col"], "left").join(total, "schema_id", "left").join(n)
    cov = F.coalesce("total", F.lit(0.0)) / F.col("n")
    lost = F.when(F.col("n_flat") == 1, cov).otherwise(F.coalesce("loss", F.lit(0.0)) / F.col("n"))
    columns = columns.select("schema_id", F.struct("e.src_type", "e.rel_type", "e.dst_type").alias("k"), F.col("e.mandatory").alias("m"), F.col("e.optional").alias("o"), (lost < w.gamma * cov / F.col("n_flat")).alias("small"))
    star = schemas.select("schema_id", F.explode("edges").alias("e")).select("schema_id", F.struct("e.src_type", "e.rel_type", "e.dst_type").alias("k"), F.col("e.mandatory").alias("m"), F.col("e.optional").alias("o"))
    twin = F.count("*").over(Window.partitionBy("schema_id", "k")) > 1
    joined = star.withColumn("twin", twin).join(columns, ["schema_id", "k", "m", "o"])
    return joined.groupBy("schema_id").agg((1.0 - F.sum((F.col("twin") | F.col("small")).cast("int")) / F.count("*")).alias("edge_concision"))


def _keys(schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    flat = flatten(schemas)
    own = lambda s: F.struct(s["labels"].alias("labels"), F.array_sort(F.array_union(s["mandatory"], s["optional"])).alias("props"))
    nodes = flat.select("schema_id", F.explode("flat_nodes").alias("s")).select("schema_id", F.to_json(own(F.col("s"))).alias("k")).distinct()
    edges = flat.select("schema_id", F.explode("flat_edges").alias("s"))
    e = F.col("s")
    edges = edges.select("schema_id", F.to_json(F.struct(e["rel_type"].alias("t"), F.array_sort(F.array_union(e["mandatory"], e["optional"])).alias("p"), own(e["src"]).alias("a"), own(e["dst"]).alias("b"))).alias("k")).distinct()
    return nodes, edges


def f1_scores(tp: Column, fp: Column, fn: Column, name: str) -> list[Column]:
    """Precision, recall and F1, 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), harmonic(p, r).alias(f"{name}_f1")]


def schema_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, F1 of each predicted schema's flat types against the one of its truth (truth_id).

    Types are equal if labels, ends and all properties are, mandatory or not.
    """
    def counts(mine: DataFrame, theirs: DataFrame, name: str) -> DataFrame:
        pairs = predicted.select("schema_id", "truth_id")
        a = mine.select("schema_id", "k", F.lit(1).alias("p"))
        b = pairs.join(theirs.withColumnRenamed("schema_id", "truth_id"), "truth_id").select("schema_id", "k", F.lit(1).alias("t"))
        both = a.join(b, ["schema_id", "k"], "full")
        one = lambda x: F.sum(x.cast("int"))
        p, t = F.col("p").isNotNull(), F.col("t").isNotNull()
        got = both.groupBy("schema_id").agg(one(p & t).alias("tp"), one(p & ~t).alias("fp"), one(~p & t).alias("fn"))
        got = pairs.select("schema_id").join(got, "schema_id", "left").fillna(0)
        return got.select("schema_id", *f1_scores(F.col("tp"), F.col("fp"), F.col("fn"), name))

    (pn, pe), (tn, te) = _keys(predicted.select("schema_id", "nodes", "edges")), _keys(truth.select("schema_id", "nodes", "edges"))
    return counts(pn, tn, "node").join(counts(pe, te, "edge"), "schema_id")
