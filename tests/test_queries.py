"""Every graph query with SQL against DuckDB; the others run and keep their invariants."""

import pytest

from strandgraph.plans.catalogue import QUERIES, SQL

from .oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    assert compare(spark, QUERIES[name], SQL[name], small) > 0
    spark.catalog.clearCache()


def members(spark, small, name):
    rows = QUERIES[name](spark, small).collect()
    spark.catalog.clearCache()
    return rows


@pytest.mark.parametrize("name", ["lsh_node_clusters", "minhash_node_clusters", "kmeans_node_clusters"])
def test_every_pattern_has_one_cluster(spark, small, name):
    rows = members(spark, small, name)
    whole = {(r["labels"], r["keys"]): r["n"] for r in members(spark, small, "label_key_set_counts")}
    assert {(r["labels"], r["keys"]): r["n"] for r in rows} == whole and len(rows) == len(whole)


def test_minhash_sees_keys_only(spark, small):
    by_keys = {}
    for r in members(spark, small, "minhash_node_clusters"):
        by_keys.setdefault(r["keys"], set()).add(r["cluster_id"])
    assert all(len(c) == 1 for c in by_keys.values())


def test_mixture_leaves(spark, small):
    rows = members(spark, small, "gmm_split")
    assert len({(r["labels"], r["keys"]) for r in rows}) == len(rows) == len(members(spark, small, "label_key_set_counts"))
    table = members(spark, small, "gmm_type_table")
    ids = {r["id"] for r in table}
    assert sum(r["is_basetype"] for r in table) == 1 and all(r["subtypeof"] in ids for r in table if not r["is_basetype"])


def test_edge_clusters_merge_by_type(spark, small):
    rows = members(spark, small, "lsh_edge_clusters")
    assert sorted(r["rel_type"] for r in rows) == ["EMITTED", "HAS_LINE", "HAS_ORDER", "LIVES_IN", "LOCATED_IN", "SUPPLIES"]
    line = next(r for r in rows if r["rel_type"] == "HAS_LINE")
    assert line["optional"] == "discount" and line["mandatory"] == "extendedprice,quantity,tax"


def test_partition_covers_labels(spark, small):
    rows = members(spark, small, "weighted_jaccard_partition")
    labels = {x for r in rows for x in r["labels"].split(":")}
    assert {"Customer", "Debtor", "Order", "Fulfilled", "Region"} <= labels


def test_sweep(spark, small):
    rows = {(r["kind"], r["level"]): r for r in members(spark, small, "inject_sweep_summary")}
    assert len(rows) == 33 and all(r["trials"] == 3 for r in rows.values())
    assert rows["node_type_missing", 5]["node_coverage"] < rows["node_type_missing", 1]["node_coverage"] < 1
    assert rows["edge_duplicate", 3]["edge_f1"] == 1 and rows["edge_duplicate", 3]["edge_coverage"] == pytest.approx(rows["edge_duplicate", 1]["edge_coverage"])
    assert rows["edge_cardinality_error", 5]["edge_f1"] == 1


def test_exports(spark, small):
    strict = [r["line"] for r in sorted(members(spark, small, "strict_ddl"), key=lambda r: r["place"])]
    assert "CREATE NODE TYPE Customer_DebtorType : Customer | Debtor {acctbal DOUBLE, mktsegment STRING, name STRING};" in strict
    assert "CREATE EDGE TYPE has_lineType : HAS_LINE {extendedprice DOUBLE, quantity DOUBLE, tax DOUBLE, OPTIONAL discount DOUBLE};" in strict
    assert any(x.startswith("FOR (x:CustomerType) SINGLETON y") or "SINGLETON" in x for x in strict)
    loose = [r["line"] for r in sorted(members(spark, small, "loose_ddl"), key=lambda r: r["place"])]
    assert loose[0] == "CREATE GRAPH TYPE NewGraphSchema LOOSE {" and loose[-1] == "}" and not any("OPTIONAL" in x for x in loose)
    xsd = {(r["name"], r["prop"]): r for r in members(spark, small, "xsd_types")}
    assert xsd["Order", "priority"]["min_occurs"] == 0 and xsd["Part", "size"]["xsd_type"] == "xs:integer"


def test_label_set_schema_extends(spark, small):
    rows = members(spark, small, "label_set_schema")
    up = {r["edge_id"] for r in rows if r["rel_type"] == "EXTENDS"}
    assert "Customer:Debtor|EXTENDS|Customer" in up and "Fulfilled:Order|EXTENDS|Order" in up


def test_sampled_types_agree(spark, small):
    full = {(r["labels"], r["prop"]): r["type"] for r in members(spark, small, "infer_types_cascade")}
    part = {(r["labels"], r["prop"]): r["type"] for r in members(spark, small, "infer_types_sampled")}
    assert full == part
    assert all(r["agrees"] for r in members(spark, small, "type_sample_agreement"))
