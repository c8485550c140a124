"""A property graph over the relational tables of an order system.

Each table gives nodes or edges; a property is left out where a rule makes it
optional, so that abstraction has something to find.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _props(**values: Column) -> Column:
    flat = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def _labels(*names: str | Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.lit(n) if isinstance(n, str) else n for n in names))))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, labels, props of all nodes."""
    t, c = lambda n: table(spark, sf_dir, n), F.col
    balance = F.when((c("c_acctbal") < 0) | (c("c_acctbal") >= 1000), c("c_acctbal"))
    urgent = F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), c("o_orderpriority"))
    parts = [
        t("region").select(_id("region", "r_regionkey").alias("node_id"), _labels("Region").alias("labels"), _props(name=c("r_name")).alias("props")),
        t("nation").select(_id("nation", "n_nationkey").alias("node_id"), _labels("Nation").alias("labels"), _props(name=c("n_name")).alias("props")),
        t("customer").select(_id("customer", "c_custkey").alias("node_id"), _labels("Customer", F.when(c("c_acctbal") < 0, F.lit("Debtor"))).alias("labels"), _props(name=c("c_name"), mktsegment=c("c_mktsegment"), acctbal=balance).alias("props")),
        t("supplier").select(_id("supplier", "s_suppkey").alias("node_id"), _labels("Supplier").alias("labels"), _props(name=c("s_name"), acctbal=c("s_acctbal")).alias("props")),
        t("part").select(_id("part", "p_partkey").alias("node_id"), _labels("Part").alias("labels"), _props(name=c("p_name"), brand=c("p_brand"), type=c("p_type"), size=c("p_size"), retailprice=c("p_retailprice")).alias("props")),
        t("orders").select(_id("order", "o_orderkey").alias("node_id"), _labels("Order", F.when(c("o_orderstatus") == "F", F.lit("Fulfilled"))).alias("labels"), _props(totalprice=c("o_totalprice"), orderdate=c("o_orderdate"), orderstatus=c("o_orderstatus"), priority=urgent).alias("props")),
        t("events").select(_id("event", "event_id").alias("node_id"), _labels("Event", F.initcap("event_type")).alias("labels"), _props(ts=c("ts"), value=c("value"), k=F.get_json_object("props", "$.k")).alias("props")),
    ]
    return _union(parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst, rel_type, props of all edges."""
    t, c = lambda n: table(spark, sf_dir, n), F.col
    none = F.create_map().cast("map<string,string>")

    def part(df: DataFrame, rel: str, src: Column, dst: Column, key: Column, props: Column = none) -> DataFrame:
        return df.select(F.concat_ws("|", F.lit(rel), key).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), props.alias("props"))

    line = t("lineitem")
    row = F.sha2(F.concat_ws("|", *(c(x).cast("string") for x in line.columns)), 256)
    parts = [
        part(t("nation"), "LOCATED_IN", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        part(t("supplier"), "LOCATED_IN", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")),
        part(t("customer"), "LIVES_IN", _id("customer", "c_custkey"), _id("nation", "c_nationkey"), _id("customer", "c_custkey")),
        part(t("orders"), "HAS_ORDER", _id("customer", "o_custkey"), _id("order", "o_orderkey"), _id("order", "o_orderkey"), _props(orderdate=c("o_orderdate"))),
        part(line, "HAS_LINE", _id("order", "l_orderkey"), _id("part", "l_partkey"), row, _props(quantity=c("l_quantity"), extendedprice=c("l_extendedprice"), tax=c("l_tax"), discount=F.when(c("l_discount") > 0, c("l_discount")))),
        part(line.select("l_suppkey", "l_partkey").distinct(), "SUPPLIES", _id("supplier", "l_suppkey"), _id("part", "l_partkey"), F.concat_ws(">", c("l_suppkey").cast("string"), c("l_partkey").cast("string"))),
        part(t("events"), "EMITTED", _id("customer", "user_id"), _id("event", "event_id"), _id("event", "event_id")),
    ]
    return _union(parts)
