"""Queries that take all of what a query beside them takes in part."""

from strandgraph.plans.catalogue import QUERIES, SQL

from .oracle import compare


def test_edge_similarities_of_all_types(spark, small):
    whole = SQL["edge_topology_similarity"].replace(" WHERE rel <> 'HAS_LINE'", "")
    assert whole != SQL["edge_topology_similarity"]
    assert compare(spark, QUERIES["edge_topology_similarity_whole"], whole, small) > 0
    rows = QUERIES["edge_topology_similarity_whole"](spark, small).collect()
    spark.catalog.clearCache()
    assert any(r["a"].startswith("HAS_LINE|") and r["b"].startswith("HAS_LINE|") for r in rows)


def test_mixtures_of_each_label_set(spark):
    from strandgraph.operators import clustering as cl

    sets = [["A"], ["A", "B"], []]
    rows = [(labels, [f"{'abcdef'[k] * (k + 2)}" for k in range(j + 1)], 10 + j) for labels in sets for j in range(5)]
    patterns = spark.createDataFrame(rows, "labels array<string>, keys array<string>, n long")
    forest = cl.mixture_forest(patterns)
    found = {}
    for r in forest.collect():
        found.setdefault(r["base"], []).append((tuple(r["labels"]), tuple(r["keys"])))
    for labels in sets:
        want = {(tuple(x), tuple(k)) for x, k, _ in rows if (set(labels) <= set(x) if labels else not x)}
        assert set(found[":".join(labels)]) == want and len(found[":".join(labels)]) == len(want)
    table = cl.type_table(forest).collect()
    assert {r["id"] for r in table if r["is_basetype"]} == {":".join(x) + "/T" for x in sets}
    assert all(r["subtypeof"] in {t["id"] for t in table} for r in table if not r["is_basetype"])


def test_mixtures_without_depth(spark, small):
    rows = QUERIES["gmm_split_whole"](spark, small).collect()
    counts = QUERIES["label_key_set_counts"](spark, small).collect()
    spark.catalog.clearCache()
    assert {r["base"] for r in rows} == {r["labels"] for r in counts}
    for base in {r["base"] for r in rows}:
        want = {(c["labels"], c["keys"]) for c in counts if (set(base.split(":")) <= set(c["labels"].split(":")) if base else not c["labels"])}
        assert {(r["labels"], r["keys"]) for r in rows if r["base"] == base} == want
    assert len({(r["base"], r["path"]) for r in rows}) > 8


def test_sweep_leaves_nothing_out(spark, small, monkeypatch):
    from inspect import signature

    from strandgraph.operators import inject as ij

    defaults = {k: p.default for k, p in signature(ij.trials).parameters.items()}
    assert (defaults["kinds"], defaults["levels"], defaults["n"]) == (ij.KINDS, (1, 2, 3, 4, 5), 100)
    real, given = ij.sweep, {}

    def few(*args, **options):
        given.update(options)
        return real(*args, **options, kinds=("edge_cardinality_error",), levels=(1, 5), n=1)

    monkeypatch.setattr(ij, "sweep", few)
    rows = {r["level"]: r for r in QUERIES["inject_sweep_whole"](spark, small).collect()}
    spark.catalog.clearCache()
    assert given == {"cardinality": True}
    assert rows[5]["edge_coverage"] < rows[1]["edge_coverage"] < 1


def test_round_trip_of_all_types(spark, small):
    types = [(r["labels"].split(":"), r["mandatory"], r["optional"]) for r in QUERIES["merge_by_labels"](spark, small).collect()]
    want = {}
    for labels, mandatory, optional in sorted(types, key=lambda t: "_".join(t[0]) + "Type"):
        for label in labels:
            want.setdefault(label, (mandatory, optional))
    rows = QUERIES["strict_ddl_round_trip_whole"](spark, small).collect()
    spark.catalog.clearCache()
    assert {r["labels"]: (r["mandatory"], r["optional"]) for r in rows} == want and len(rows) == len(want)
    assert {"Event", "Debtor", "Fulfilled"} <= set(want)
