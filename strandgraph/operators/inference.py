"""Data types of properties and cardinalities of relationship types.

All keys of all types are judged in one grouped aggregation over exploded
properties: a type holds if no value breaks its test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import end_labels

#: Fixed value: a key that always holds text.
TEXT_KEYS = ("locationIP",)
BOOLEANS = ("true", "false", "yes", "no", "1", "0")


def is_integer(v: Column) -> Column:
    return F.trim(v).rlike("^[+-]?[0-9]+$") & F.trim(v).try_cast("int").isNotNull()


def is_double(v: Column) -> Column:
    return F.trim(v).try_cast("double").isNotNull()


def is_date(v: Column, strict: bool = False) -> Column:
    """A lenient year is a date: any text that begins with a digit, or with - and one. ``strict``: whole dates."""
    if strict:
        return F.trim(v).rlike("^[0-9]{4}([-/.])[0-9]{1,2}\\1[0-9]{1,2}([ T][0-9:.]+(Z|[+-][0-9:]+)?)?$|^[0-9]{1,2}([-/.])[0-9]{1,2}\\4[0-9]{4}$")
    return F.trim(v).rlike("^-?[0-9]")


def is_boolean(v: Column) -> Column:
    return F.lower(F.trim(v)).isin(*BOOLEANS)


def is_ip(v: Column) -> Column:
    return F.trim(v).rlike("^((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")


def values(rows: DataFrame, key: list[str], sample: int | None = None) -> DataFrame:
    """key..., prop, value; with a sample at most so many of each, the first by hash."""
    out = rows.select(*key, F.explode("props").alias("prop", "value")).where("value is not null")
    if sample:
        first = F.row_number().over(Window.partitionBy(*key, "prop").orderBy(F.xxhash64("value"), "value"))
        out = out.withColumn("_r", first).where(F.col("_r") <= sample).drop("_r")
    return out


def infer_types(rows: DataFrame, key: list[str], sample: int | None = None, strict_dates: bool = False) -> DataFrame:
    """key..., prop, n, type: String for addresses, else the first of Integer, Double, Date, Boolean that all values pass.

    A property that no row has is absent; one whose values are all blank is String.
    """
    v, every = F.col("value"), lambda test: F.bool_and(F.coalesce(test, F.lit(False)))
    found = values(rows, key, sample).groupBy(*key, "prop").agg(
        F.count("*").alias("n"), every(is_ip(v)).alias("ip"), every(is_integer(v)).alias("integer"), every(is_double(v)).alias("double"), every(is_date(v, strict_dates)).alias("date"), every(is_boolean(v)).alias("boolean")
    )
    name = F.when(F.col("prop").isin(*TEXT_KEYS) | F.col("ip"), "String").when(F.col("integer"), "Integer").when(F.col("double"), "Double").when(F.col("date"), "Date").when(F.col("boolean"), "Boolean").otherwise("String")
    return found.select(*key, "prop", "n", name.alias("type"))


def kind_of(v: Column) -> Column:
    """The first type that one value passes."""
    return F.when(is_ip(v), "String").when(is_integer(v), "Integer").when(is_double(v), "Double").when(is_date(v), "Date").when(is_boolean(v), "Boolean").otherwise("String")


def type_support(rows: DataFrame, key: list[str], bins: int = 5) -> DataFrame:
    """key..., prop, n, majority, support, bin: the commonest type of the values, its share and that share's bin."""
    counts = values(rows, key).groupBy(*key, "prop", kind_of(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*key, "prop")
    ranked = counts.withColumn("total", F.sum("n").over(of)).withColumn("r", F.row_number().over(of.orderBy(F.desc("n"), "kind"))).where("r = 1")
    support = F.col("n") / F.col("total")
    return ranked.select(*key, "prop", F.col("total").alias("n"), F.col("kind").alias("majority"), support.alias("support"), F.least(F.lit(bins), F.floor(support * bins) + 1).cast("int").alias("bin"))


def support_agreement(rows: DataFrame, key: list[str], sample: int = 1000) -> DataFrame:
    """key..., prop, agrees, delta: whether a sample's majority is that of all values, and how far the shares differ."""
    full = type_support(rows, key).select(*key, "prop", "majority", "support")
    v = values(rows, key, sample).groupBy(*key, "prop", kind_of(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*key, "prop")
    part = v.withColumn("share", F.col("n") / F.sum("n").over(of)).withColumn("r", F.row_number().over(of.orderBy(F.desc("n"), "kind"))).where("r = 1").select(*key, "prop", F.col("kind").alias("sampled"), "share")
    return full.join(part, [*key, "prop"]).select(*key, "prop", (F.col("majority") == F.col("sampled")).alias("agrees"), F.abs(F.col("support") - F.col("share")).alias("delta"))


def degrees(edges: DataFrame, key: list[str]) -> DataFrame:
    """key..., max and mean number of distinct ends: of destinations of a source, and the reverse."""
    ends = edges.select(*key, "src", "dst").distinct()

    def side(one: str, name: str) -> DataFrame:
        per = ends.groupBy(*key, one).agg(F.count("*").alias("d"))
        return per.groupBy(*key).agg(F.max("d").alias(f"max_{name}"), F.min("d").alias(f"min_{name}"), F.avg("d").alias(f"avg_{name}"))

    return side("src", "out").join(side("dst", "in"), key)


def cardinality(max_out: Column, max_in: Column) -> Column:
    """source:destination, N where one end has several others."""
    code = F.concat(F.when(max_in > 1, "N").otherwise("1"), F.lit(":"), F.when(max_out > 1, "N").otherwise("1"))
    return F.when(max_out.isNull() | max_in.isNull() | (max_out < 1) | (max_in < 1), "Unknown").otherwise(code)


def cardinalities(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Cardinality of each relationship type, or of each (source labels, type, destination labels)."""
    key = ["rel_type"] if nodes is None else ["src_labels", "rel_type", "dst_labels"]
    rows = edges if nodes is None else end_labels(edges.select("src", "dst", "rel_type"), nodes)
    found = degrees(rows, key)
    return found.withColumn("cardinality", cardinality(F.col("max_out"), F.col("max_in")))


def cluster_cardinality(clusters: DataFrame, by_type: DataFrame) -> DataFrame:
    """cluster_id, cardinality: the codes of a cluster's relationship types (rel_types), joined by commas."""
    rows = clusters.select("cluster_id", F.explode("rel_types").alias("rel_type")).join(by_type.select("rel_type", "cardinality"), "rel_type", "left")
    return rows.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("cardinality", F.lit("Unknown")))), ",").alias("cardinality"))
