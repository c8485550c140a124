"""Node and edge types by clustering feature vectors: LSH, MinHash, k-means, mixtures.

Vectors are made of distinct (label set, key set) patterns, weighted by how many
instances have them, so fitting never touches instance rows; a pattern's cluster
is its instances' cluster.
"""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH, MinHashLSH, Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import bigram_dice, euclidean
from .discovery import match_unlabelled, merge_by_labels
from .patterns import presence

SEED = 1


def hashed_embedding(name: Column, size: int) -> Column:
    """``size`` numbers in [-0.5, 0.5) for a name: a label set's random code, the same in every run."""
    return F.array(*(F.pmod(F.xxhash64(name, F.lit(k)), F.lit(1 << 20)) / float(1 << 20) - 0.5 for k in range(size)))


def all_keys(patterns: DataFrame) -> list[str]:
    """The key union of the patterns: type-level, as many as the graph has properties."""
    return [r[0] for r in patterns.select(F.explode("keys")).distinct().orderBy("col").collect()]


def bits(keys: list[str]) -> Column:
    if not keys:
        return F.array().cast("array<double>")
    return presence(F.map_from_entries(F.transform("keys", lambda k: F.struct(k, F.lit(1)))), keys)


def node_vectors(patterns: DataFrame, size: int = 5, word2vec: bool = False) -> DataFrame:
    """pattern rows with features: a code of the label set, then a bit for each key."""
    keys = all_keys(patterns)
    name = F.array_join("labels", ":")
    if word2vec:
        model = Word2Vec(vectorSize=size, minCount=0, seed=SEED, inputCol="_words", outputCol="_code").fit(patterns.select(F.array(name).alias("_words")))
        from pyspark.ml.functions import vector_to_array

        coded = model.transform(patterns.withColumn("_words", F.array(name))).withColumn("_c", vector_to_array("_code")).drop("_words", "_code")
    else:
        coded = patterns.withColumn("_c", hashed_embedding(name, size))
    return coded.withColumn("features", array_to_vector(F.concat("_c", bits(keys)))).withColumn("bits", bits(keys)).drop("_c")


def edge_vectors(patterns: DataFrame) -> DataFrame:
    """pattern rows (src_labels, rel_type, dst_labels, keys) with features: codes of 10, 4 and 4 numbers, then bits."""
    keys = all_keys(patterns)
    codes = F.concat(hashed_embedding(F.col("rel_type"), 10), hashed_embedding(F.array_join("src_labels", ":"), 4), hashed_embedding(F.array_join("dst_labels", ":"), 4))
    return patterns.withColumn("features", array_to_vector(F.concat(codes, bits(keys)))).withColumn("bits", bits(keys))


def pair_distances(patterns: DataFrame, sample: int = 200) -> DataFrame:
    """mean, least, most, deviation of distances between patterns, over a bounded sample of them."""
    from pyspark.ml.functions import vector_to_array

    rows = patterns.select(vector_to_array("features").alias("v"), F.xxhash64("labels", "keys").alias("h")).orderBy("h").limit(sample)
    a, b = rows.select(F.col("v").alias("a"), F.col("h").alias("ha")), rows.select(F.col("v").alias("b"), F.col("h").alias("hb"))
    d = euclidean(F.col("a"), F.col("b"))
    pairs = a.join(b, F.col("ha") < F.col("hb")).select(d.alias("d"))
    return pairs.agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("deviation"))


def lsh_parameters(mean: float | None, rows: int, label_sets: int, edges: bool = False) -> tuple[float, int]:
    """Bucket length and number of tables from the mean distance, the rows and the label sets."""
    import math

    low, high = (3, 20) if edges else (5, 25)
    tables = min(high, max(low, math.log10(max(rows, 1))))
    bucket = 1.2 * (mean or 0.0)
    grade = 0 if label_sets <= 3 else 1 if label_sets <= 10 else 2
    if not edges:
        bucket *= (0.8, 1.0, 1.5)[grade]
        tables = max(15, tables * (1.5, 1.0, 0.8)[grade])
    return bucket if bucket > 0 else 0.2, int(tables) or 5


def _named(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("cluster_id", by).drop("features", "bits", "hashes")


def lsh_clusters(vectors: DataFrame, bucket: float, tables: int) -> DataFrame:
    """Patterns that agree in all hash tables are a cluster."""
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=SEED).fit(vectors)
    return _named(model.transform(vectors), F.sha2(F.col("hashes").cast("string"), 256))


def minhash_clusters(vectors: DataFrame, tables: int = 25) -> DataFrame:
    """The same by MinHash of which numbers are not 0: label codes never are, so only keys tell patterns apart."""
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=tables, seed=SEED).fit(vectors)
    return _named(model.transform(vectors), F.sha2(F.col("hashes").cast("string"), 256))


def kmeans_clusters(vectors: DataFrame, k: int = 10) -> DataFrame:
    rows = min(k, vectors.count())
    if rows < 2:
        return _named(vectors, F.lit("0"))
    model = KMeans(k=rows, seed=SEED, featuresCol="features", predictionCol="_k", weightCol="n").fit(vectors.withColumn("n", F.col("n").cast("double")))
    return _named(model.transform(vectors.withColumn("n", F.col("n").cast("double"))).withColumn("n", F.col("n").cast("long")), F.col("_k").cast("string")).drop("_k")


def cluster_nodes(patterns: DataFrame, method: str = "LSH") -> DataFrame:
    """patterns with cluster_id by LSH, MINHASH or KMEANS; ALL is MinHash and k-means, in two columns."""
    vectors = node_vectors(patterns).cache()
    if method == "LSH":
        mean = pair_distances(vectors).head()["mean"]
        return lsh_clusters(vectors, *lsh_parameters(mean, vectors.count(), vectors.select("labels").distinct().count()))
    if method == "MINHASH":
        return minhash_clusters(vectors)
    if method == "KMEANS":
        return kmeans_clusters(vectors)
    if method == "ALL":
        second = kmeans_clusters(vectors).select("labels", "keys", F.col("cluster_id").alias("kmeans_id"))
        return minhash_clusters(vectors).join(second, ["labels", "keys"])
    raise ValueError(f"no such method: {method}")


def discovered_node_types(clusters: DataFrame, threshold: float = 0.9) -> DataFrame:
    """labels, members, clusters, mandatory, optional: clusters merged by label set, unlabelled ones by their keys."""
    bare = clusters.select(F.concat_ws("|", F.array_join("labels", ":"), F.array_join("keys", ",")).alias("type_id"), "labels", "keys", "cluster_id", "n")
    matched = match_unlabelled(bare, threshold).join(bare.select(F.col("type_id").alias("match"), F.col("labels").alias("found")), "match").select("type_id", "found")
    rows = bare.join(matched, "type_id", "left").select("cluster_id", F.coalesce("found", "labels").alias("labels"), "keys", "n")
    return merge_by_labels(rows)


def edge_clusters(patterns: DataFrame, method: str = "LSH") -> DataFrame:
    """Edge patterns with cluster_id by LSH, MINHASH or KMEANS."""
    vectors = edge_vectors(patterns).cache()
    if method == "KMEANS":
        return kmeans_clusters(vectors)
    bucket, tables = lsh_parameters(0.5, vectors.count(), vectors.select("rel_type").distinct().count(), edges=True)
    if method == "MINHASH":
        return minhash_clusters(vectors, tables)
    if method == "LSH":
        return lsh_clusters(vectors, bucket, tables)
    raise ValueError(f"no such method: {method}")


def merge_edge_clusters(clusters: DataFrame, by_ends: bool = True) -> DataFrame:
    """Edge clusters merged by (type, end labels), or by type alone with the ends' label sets united."""
    if by_ends:
        key, rows = ["rel_type", "src_labels", "dst_labels"], clusters
    else:
        key = ["rel_type"]
        ends = clusters.groupBy("rel_type").agg(F.array_sort(F.collect_set(F.array_join("src_labels", ":"))).alias("src_sets"), F.array_sort(F.collect_set(F.array_join("dst_labels", ":"))).alias("dst_sets"))
        rows = clusters
    total = rows.groupBy(*key).agg(F.sum("n").alias("members"))
    keys = rows.select(*key, "n", F.explode("keys").alias("k")).groupBy(*key, "k").agg(F.sum("n").alias("c")).join(total, key)
    none = F.array().cast("array<string>")
    split = keys.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("c") == F.col("members"), F.col("k")))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("c") < F.col("members"), F.col("k")))).alias("o"))
    merged = total.join(split, key, "left").select(*key, "members", F.coalesce("m", none).alias("mandatory"), F.coalesce("o", none).alias("optional"))
    return merged if by_ends else merged.join(ends, "rel_type")


# --- mixtures ---------------------------------------------------------------
def sampled(patterns: DataFrame, percent: int = 80) -> DataFrame:
    """Patterns with the number of their instances that a sample of ``percent`` takes, one at least."""
    return patterns.withColumn("n", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * percent / 100 + 0.5)))


def word(labels: Column, keys: Column) -> Column:
    return F.concat_ws(" ", F.concat(labels, keys))


def mixture_split(patterns: DataFrame, reference: str) -> DataFrame:
    """patterns with half (0, 1): a mixture of two normals over bigram similarity to the reference."""
    rows = patterns.withColumn("x", bigram_dice(word(F.col("labels"), F.col("keys")), F.lit(reference)))
    kinds = rows.select("x").distinct().limit(3).count()
    if kinds < 2:
        return rows.withColumn("half", F.lit(0)).drop("x")
    made = rows.withColumn("features", array_to_vector(F.array("x"))).withColumn("w", F.col("n").cast("double"))
    model = GaussianMixture(k=2, tol=1.0, maxIter=10, seed=42, weightCol="w", predictionCol="half").fit(made)
    return model.transform(made).drop("features", "w", "probability", "x")


def mixture_tree(patterns: DataFrame, depth: int | None = None) -> DataFrame:
    """patterns with path: halves by mixtures, halved again until a split gives no two, or to a depth.

    The reference of a half is its most frequent pattern's word.  Patterns are
    type-level rows; each split is one fit over them.
    """
    spark, schema = patterns.sparkSession, "labels array<string>, keys array<string>, n long"
    done: list[tuple] = []
    work = [("", [tuple(r) for r in patterns.select("labels", "keys", "n").collect()])]  # type-level rows
    while work:
        path, rows = work.pop()
        if not rows:
            continue
        top = min(rows, key=lambda r: (-r[2], " ".join([*r[0], *r[1]])))
        halves: dict[int, list[tuple]] = {}
        if len(rows) > 1 and (depth is None or len(path) < depth):
            made = mixture_split(spark.createDataFrame(rows, schema).coalesce(1), " ".join([*top[0], *top[1]]))
            for r in made.select("labels", "keys", "n", "half").collect():
                halves.setdefault(r["half"], []).append(tuple(r)[:3])
        if len(halves) < 2:
            done += [(*r, path or "0") for r in rows]
        else:
            work += [(path + str(h), halves[h]) for h in (0, 1)]
    return spark.createDataFrame(done, f"{schema}, path string")


def mixture_forest(patterns: DataFrame) -> DataFrame:
    """patterns with base and path: a tree for each label set, of all patterns with its labels; unlabelled ones apart.

    A pattern is a row of each tree it is in, and each tree is complete: the
    reference leaves out of a tree the clusters that an earlier one has.
    """
    rows = patterns.select("labels", "keys", "n").cache()  # type-level rows
    made: DataFrame | None = None
    for labels in sorted(r["labels"] for r in rows.select("labels").distinct().collect()):
        held = F.size("labels") == 0 if not labels else F.size(F.array_except(F.array(*map(F.lit, labels)), "labels")) == 0
        tree = mixture_tree(rows.where(held)).withColumn("base", F.lit(":".join(labels)))
        made = tree if made is None else made.unionByName(tree)
    return made if made is not None else rows.select("*", F.lit("").alias("path"), F.lit("").alias("base"))


def type_table(tree: DataFrame) -> DataFrame:
    """id, labels, properties (? for optional), subtypeof, type, is_basetype: a row for every node of the tree, or of each base's tree."""
    based = "base" in tree.columns
    levels = (tree if based else tree.withColumn("base", F.lit(""))).select("*", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("d")).withColumn("at", F.expr("substring(path, 1, d)"))
    n = levels.groupBy("base", "at").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
    keys = levels.select("base", "at", "n", F.explode("keys").alias("k")).groupBy("base", "at", "k").agg(F.sum("n").alias("c")).join(n.select("base", "at", "n"), ["base", "at"])
    props = keys.groupBy("base", "at").agg(F.array_join(F.array_sort(F.collect_list(F.concat("k", F.when(F.col("c") < F.col("n"), "?").otherwise("")))), ":").alias("properties"))
    name = lambda p: F.concat(*([F.col("base"), F.lit("/")] if based else []), F.lit("T"), p)
    up = F.when(F.length("at") > 0, name(F.expr("substring(at, 1, length(at) - 1)")))
    return n.join(props, ["base", "at"], "left").select(name(F.col("at")).alias("id"), F.array_join("labels", ":").alias("labels"), F.coalesce("properties", F.lit("")).alias("properties"), up.alias("subtypeof"), F.lit("node").alias("type"), (F.length("at") == 0).alias("is_basetype"))
