"""How well predicted clusters agree with known labels: majority precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import f1_scores


def majority(rows: DataFrame) -> DataFrame:
    """cluster_id, majority: the commonest label of a cluster (cluster_id, label, n), ties to the first by name."""
    counts = rows.groupBy("cluster_id", "label").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "label"))
    return counts.withColumn("r", first).where("r = 1").select("cluster_id", F.col("label").alias("majority"))


def majority_scores(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of (cluster_id, label, n), n instances a row.

    A member with its cluster's majority label is a true positive, others are false
    ones; what a label has more than is predicted for it is missed.
    """
    judged = rows.join(majority(rows), "cluster_id")
    hit = F.col("label") == F.col("majority")
    found = judged.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    actual = rows.groupBy("label").agg(F.sum("n").alias("actual"))
    predicted = judged.groupBy(F.col("majority").alias("label")).agg(F.sum("n").alias("predicted"))
    missed = actual.join(predicted, "label", "left").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("actual") - F.coalesce("predicted", F.lit(0)))).alias("fn"))
    both = found.join(F.broadcast(missed))  # one row each
    return both.select("tp", "fp", "fn", *f1_scores(F.col("tp"), F.col("fp"), F.col("fn"), "majority"))


def with_truth(predicted: DataFrame, truth: DataFrame, key: str = "node_id", optional: bool = False) -> DataFrame:
    """predicted (key, cluster_id) with label of truth (key, label), n = 1; ``optional`` keeps unknown ones."""
    rows = predicted.join(truth.select(key, "label"), key, "left" if optional else "inner")
    return rows.select(key, "cluster_id", F.coalesce("label", F.lit("")).alias("label"), F.lit(1).alias("n"))
