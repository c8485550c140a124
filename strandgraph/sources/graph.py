"""Reading and writing graphs, schemas, type tables and rank tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CARDINALITY_ERROR, EDGE, NODE, SOURCE_ID, canonical, canonical_edges, canonical_nodes
from ..operators.patterns import optional_mark


def scan_nodes(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """node_id, labels, props of a graph folder."""
    return canonical_nodes(spark.read.format(form).schema("node_id string, labels array<string>, props map<string,string>").load(f"{path}/nodes"))


def scan_edges(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return canonical_edges(spark.read.format(form).schema("edge_id string, src string, dst string, rel_type string, props map<string,string>").load(f"{path}/edges"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    nodes.write.format(form).mode(mode).save(f"{path}/nodes")
    edges.write.format(form).mode(mode).save(f"{path}/edges")


def copy_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """The graph with each node's old id kept as a property."""
    kept = nodes.withColumn("props", F.map_concat(F.map_filter("props", lambda k, _: k != SOURCE_ID), F.create_map(F.lit(SOURCE_ID), F.col("node_id"))))
    write_graph(kept, edges, path, form)


def query(spark: SparkSession, text: str, nodes: DataFrame, edges: DataFrame, **args) -> DataFrame:
    """SQL over views ``nodes`` and ``edges``, with named parameters."""
    return spark.sql(text, args=args or None, nodes=nodes, edges=edges) if "{nodes}" in text or "{edges}" in text else _with_views(spark, text, nodes, edges, args)


def _with_views(spark: SparkSession, text: str, nodes: DataFrame, edges: DataFrame, args: dict) -> DataFrame:
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    return spark.sql(text, args=args or None)


def catalogue(spark: SparkSession, folder: str) -> list[str]:
    """Names of the graphs in a folder of any file system Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "nodes")))


def schema_from_graph(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The schema row of a schema graph: property values that end in ? mark optional properties.

    A copy's source id is no property; a cardinality mark becomes the edge type's
    flag.  An edge whose end is missing raises.
    """
    split = lambda skip: [
        F.array_sort(F.map_keys(F.map_filter("props", lambda k, v: ~k.isin(*skip) & (F.lit(kind) == optional_mark(v))))).alias(alias) for kind, alias in ((False, "mandatory"), (True, "optional"))
    ]
    n = nodes.select(F.col("node_id").alias("type_id"), canonical(F.col("labels")).alias("labels"), *split((SOURCE_ID,)))
    ends = edges.join(nodes.select(F.col("node_id").alias("src"), F.lit(1).alias("s")), "src", "left").join(nodes.select(F.col("node_id").alias("dst"), F.lit(1).alias("d")), "dst", "left")
    checked = F.when(F.col("s").isNull() | F.col("d").isNull(), F.raise_error(F.concat(F.lit("an end of this edge type is missing: "), "edge_id"))).otherwise(F.col("rel_type")).alias("rel_type")
    e = ends.select("edge_id", checked, *split((SOURCE_ID, CARDINALITY_ERROR)), F.col("src").alias("src_type"), F.col("dst").alias("dst_type"), F.map_contains_key("props", F.lit(CARDINALITY_ERROR)).alias("card_error"))
    rows = lambda df, kind: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).cast(f"array<{kind}>").alias("x"))
    return rows(n, NODE).withColumnRenamed("x", "nodes").join(F.broadcast(rows(e, EDGE).withColumnRenamed("x", "edges"))).select(F.lit(name).alias("schema_id"), "nodes", "edges")  # one row each


def schema_to_graph(schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema graphs of schema rows: nodes and edges with schema_id and properties marked."""
    props = lambda t: F.map_from_entries(F.concat(F.transform(t["mandatory"], lambda p: F.struct(p.alias("k"), F.lit("mandatory").alias("v"))), F.transform(t["optional"], lambda p: F.struct(p.alias("k"), F.lit("optional?").alias("v")))))
    n = schemas.select("schema_id", F.explode("nodes").alias("t")).select("schema_id", F.col("t.type_id").alias("node_id"), F.col("t.labels").alias("labels"), props(F.col("t")).alias("props"))
    e = schemas.select("schema_id", F.explode("edges").alias("t"))
    flag = F.when(F.col("t.card_error"), F.create_map(F.lit(CARDINALITY_ERROR), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    e = e.select("schema_id", F.col("t.edge_id").alias("edge_id"), F.col("t.src_type").alias("src"), F.col("t.dst_type").alias("dst"), F.col("t.rel_type").alias("rel_type"), F.map_concat(props(F.col("t")), flag).alias("props"))
    return n, e


def write_type_table(table: DataFrame, path: str) -> None:
    """id, labels, properties, subtypeof, type, is_basetype as CSV with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_type_table(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, labels string, properties string, subtypeof string, type string, is_basetype boolean"
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.where(~(F.col("is_basetype") & F.coalesce(F.col("properties") == "", F.lit(True))))


def types_to_graph(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A type table as a schema graph: a node a row, EXTENDS to its parent where that is stored."""
    names = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ":"), lambda x: x != "")
    nodes = table.select(F.col("id").alias("node_id"), F.array_sort(names("labels")).alias("labels"), F.map_from_entries(F.transform(names("properties"), lambda p: F.struct(F.rtrim(p, F.lit("?")), F.when(F.endswith(p, F.lit("?")), "optional?").otherwise("mandatory")))).alias("props"))
    up = table.where("subtypeof is not null").join(table.select(F.col("id").alias("subtypeof")), "subtypeof", "left_semi")
    edges = up.select(F.concat_ws("|", "id", "subtypeof").alias("edge_id"), F.col("id").alias("src"), F.col("subtypeof").alias("dst"), F.lit("EXTENDS").alias("rel_type"), F.create_map().cast("map<string,string>").alias("props"))
    return nodes, edges


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_ranks(table: DataFrame, path: str, line_end: str = "\n") -> None:
    """A rank table as one CSV file; Spark ends lines with \\n or \\r."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", line_end).csv(path)


def write_results(scores: DataFrame, path: str) -> None:
    """Score rows as CSV; failed rows carry their message in an error column."""
    scores.write.mode("append").option("header", True).csv(path)
