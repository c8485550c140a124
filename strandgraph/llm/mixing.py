"""Mix sources to target weights by systematic sampling, in DataFrame operations.

A document's expected copies are its source's target over its source's size.
Their running sum within the source, from a random offset on, crosses whole
numbers; each crossing emits the document once.  Documents stand in order of
size, so that equal stretches of the running sum hold about equal words.

The running sum needs only a document's position in its source.  Positions come
from counts by (source, size, slice of the ids) rather than from one window over
a source, so a source with a third of all rows, or a third of all rows of one
size, is never sorted in one task.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; repeated rows are mixed separately; documents of size 0 can be
taken but add no words; a source whose size is 0 has target 0; an empty table
gives an empty table; other columns pass, but for columns named like an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_id, stored

#: Weights by source, in order of their names, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Slices of the documents of one source and size.
SLICES = 64
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), a row a source.

    Targets are the weights' shares of ``share`` times all words, none above
    ``most`` times its source; what is over is shared again.  So a target is
    the smaller of that bound and weight times one common level: sources are
    full in order of bound over weight, as long as the level of the rest allows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(most))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    filled = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    common = F.max(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level"))).over(everything)
    target = F.least(F.col("bound"), F.coalesce(common * F.col("weight"), F.col("bound")))
    return rows.select("source", "source_size", target.alias("target"))


def offset(seed: int) -> Column:
    """The source's random start in [0, 1), the same in every run."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("source"), F.lit("")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the kept columns: a row a document."""
    sized = stored(df.select(row_id(doc_id).alias("_id"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), *keep))
    sized = sized.withColumn("_slice", F.pmod("_id", F.lit(SLICES)))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source")
    sized = sized.withColumn("_source", key)

    by_slice = sized.groupBy("_source", "size", "_slice").agg(F.count("*").alias("n"))
    by_size = by_slice.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    size_from = by_size.select("_source", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("size_from"))
    slices = Window.partitionBy("_source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_from = by_slice.select("_source", "size", "_slice", F.coalesce(F.sum("n").over(slices), F.lit(0)).alias("slice_from"))
    starts = slice_from.join(size_from, ["_source", "size"]).withColumn("first", F.col("size_from") + F.col("slice_from")).drop("size_from", "slice_from")

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, share, most)
    goals = goals.withColumn("_source", key).withColumn("_start", offset(seed)).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("_rate", F.least(rate, F.lit(most)))

    place = F.row_number().over(Window.partitionBy("_source", "size", "_slice").orderBy("_id")) - 1
    placed = sized.withColumn("_place", place).join(starts, ["_source", "size", "_slice"]).join(goals, "_source")
    at = F.col("first") + F.col("_place")
    copies = F.floor((at + 1) * F.col("_rate") + F.col("_start")) - F.floor(at * F.col("_rate") + F.col("_start"))
    copies = copies.cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """``df`` as the mix takes it: each row as often as its copies say, or not at all."""
    named = df.withColumn("_row", row_id(doc_id)).withColumn("_text", F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(source), F.lit(""))))
    copies = mix_sources(named, text, source, doc_id, keep=("_row", "_text"), **options).where("copies > 0")
    copies = copies.groupBy("_row", "_text").agg(F.sum("copies").alias("_copies"))
    repeated = bool(named.groupBy("_row").count().where("count > 1").head(1))
    rows = named.dropDuplicates(["_row", "_text"]) if repeated else named  # equal rows share their copies
    taken = rows.join(copies, ["_row", "_text"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*df.columns)
