"""Edge partitions, their attachment by exact label sets, and edges by helper strings."""

import pytest

from strandgraph.operators import clustering as cl
from strandgraph.operators import discovery as di
from strandgraph.plans.catalogue import QUERIES


def rows(spark, small, name):
    got = [tuple(r) for r in QUERIES[name](spark, small).collect()]
    spark.catalog.clearCache()
    return got


def test_attached_edges(spark, small):
    sets = {r[1] for r in rows(spark, small, "weighted_jaccard_partition")}
    found = rows(spark, small, "weighted_jaccard_edge_partition")
    assert sorted(rows(spark, small, "weighted_jaccard_attached_edges")) == sorted(r for r in found if r[1] in sets and r[2] in sets)


def test_edge_partition_keys(spark):
    """Two types of one part: keys of both are mandatory, others optional, and ends stay apart."""
    schema = "type_id string, labels array<string>, src_labels array<string>, dst_labels array<string>, keys array<string>"
    types = spark.createDataFrame([("a", ["R"], ["A"], ["B"], ["p", "q"]), ("b", ["R"], ["B"], ["A", "C"], ["p"]), ("c", ["S"], [], ["B"], [])], schema)
    made = di.partition_edge_types(types, spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "type_id string, part int"))
    want = [("R", ["A"], ["B"], ["p"], ["q"]), ("R", ["B"], ["A", "C"], ["p"], ["q"]), ("S", [], ["B"], [], [])]
    assert sorted(tuple(r)[1:] for r in made.select("part", "rel_type", "src_labels", "dst_labels", "mandatory", "optional").collect()) == want
    nodes = spark.createDataFrame([(["A"],), (["B"],), (["B"],), (["A", "C", "D"],)], "labels array<string>")
    attached = di.attach_edges(made.unionByName(made), nodes).select("rel_type", "src_labels", "dst_labels").collect()
    assert [tuple(r) for r in attached] == [("R", ["A"], ["B"])]


def test_edges_by_strings(spark):
    types = spark.createDataFrame([("1", "A", "x"), ("2", "B", "x,y"), ("3", "B", "x,y")], "id string, labels string, properties string")
    triples = [("A?", "x", "R", "B", "x,y"), ("A", "x", "R", "B", "x,y"), ("B", "x,y", "S", "A?", "x"), ("A", "y", "T", "A", "x")]
    table = spark.createDataFrame(triples, "src_labels string, src_properties string, rel_type string, dst_labels string, dst_properties string")
    assert sorted(map(tuple, di.edges_by_strings(table, types).collect())) == [("1", "R", "2"), ("1", "R", "3")]
    assert di.edges_by_strings(table.limit(0), types).count() == 0


@pytest.mark.parametrize("method", ["LSH", "MINHASH", "KMEANS"])
def test_each_edge_pattern_has_one_cluster(spark, method):
    patterns = [(["A"], "R", ["B"], ["p"], 3), (["A"], "R", ["B"], ["p", "q"], 1), ([], "S", ["B"], [], 2), (["A"], "S", [], ["q"], 5)]
    df = spark.createDataFrame(patterns, "src_labels array<string>, rel_type string, dst_labels array<string>, keys array<string>, n long")
    made = cl.edge_clusters(df, method).collect()
    assert sorted((r["src_labels"], r["rel_type"], r["dst_labels"], r["keys"], r["n"]) for r in made) == sorted(patterns)
    assert all(r["cluster_id"] is not None for r in made)
    with pytest.raises(ValueError):
        cl.edge_clusters(df, "NONE")
