"""Types of a growing graph: mergeable counts, batch by batch or as a stream.

Counts by (label set, key) add up, so types found page by page, or by a stream,
are those of the whole graph; nothing is lost in merging.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import present
from ..operators.abstraction import split_counts

COUNTS = "labels array<string>, key string, n long"


def counts(nodes: DataFrame) -> DataFrame:
    """labels, key, n: nodes with the key; key '' counts all nodes of the label set."""
    keys = F.concat(F.array(F.lit("")), present(F.col("props")))
    return nodes.select("labels", F.explode(keys).alias("key")).groupBy("labels", "key").agg(F.count("*").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("labels", "key").agg(F.sum("n").alias("n"))


def types(state: DataFrame) -> DataFrame:
    """labels, n, mandatory, optional from counts."""
    return split_counts(state.withColumnRenamed("key", "k"), ["labels"])


def by_page(nodes: DataFrame) -> DataFrame:
    """Types of (page, node) rows by way of each page's own counts."""
    keys = F.concat(F.array(F.lit("")), present(F.col("props")))
    pages = nodes.select("page", "labels", F.explode(keys).alias("key")).groupBy("page", "labels", "key").agg(F.count("*").alias("n"))
    return types(pages.groupBy("labels", "key").agg(F.sum("n").alias("n")))


def stream_counts(nodes: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Keeps the counts of a stream of nodes in a memory table of the name."""
    return counts(nodes).writeStream.outputMode(mode).format("memory").queryName(name).start()


def stream_batches(nodes: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends each micro-batch's counts, keyed by its number, to a table; ``then`` sees all merged counts.

    A batch that is run again overwrites its own part, so counts are exact after failures.
    """
    def one(batch: DataFrame, number: int) -> None:
        counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(merged(batch.sparkSession.read.parquet(path)))

    return nodes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("labels", "key").agg(F.sum("n").alias("n"))


def drift(events: DataFrame, window: str = "1 day", late: str | None = "2 hours") -> DataFrame:
    """start, event_type, key, n, total of events (ts, event_type, props JSON) by time window; streams need ``late``."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    keys = F.concat(F.array(F.lit("")), F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")))
    exploded = rows.select("ts", "event_type", F.explode(keys).alias("key"))
    return exploded.groupBy(F.window("ts", window).alias("w"), "event_type", "key").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "key", "n")


def merge_discovered(a: DataFrame, b: DataFrame, key: str = "labels") -> DataFrame:
    """Discovered types of two batches merged by key: members add up, a key is mandatory if both have it so."""
    both = a.select(key, "members", "mandatory", "optional").unionByName(b.select(key, "members", "mandatory", "optional"))
    rows = both.groupBy(key).agg(F.sum("members").alias("members"), F.collect_list("mandatory").alias("ms"), F.array_distinct(F.flatten(F.collect_list(F.concat("mandatory", "optional")))).alias("every"))
    common = F.aggregate("ms", F.get("ms", F.lit(0)), lambda x, y: F.array_intersect(x, y))
    return rows.select(key, "members", F.array_sort(common).alias("mandatory"), F.array_sort(F.array_except("every", common)).alias("optional"))
