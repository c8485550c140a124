"""Sources, DDL, streams, statistics and inference on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from strandgraph.model import Schema, canonical, schemas
from strandgraph.operators import abstraction as ab
from strandgraph.operators import discovery as di
from strandgraph.operators import evaluate as ev
from strandgraph.operators import inference as inf
from strandgraph.operators import inject as ij
from strandgraph.operators import patterns as pa
from strandgraph.operators import rank_stats as rs
from strandgraph.operators.clustering import lsh_parameters
from strandgraph.sources import ddl
from strandgraph.sources import graph as g
from strandgraph.streaming import incremental as inc

NODES = [("1", ["A"], {"x": "1", "y": None}), ("2", ["A"], {"x": "2", "z": "q"}), ("3", ["B", "A"], {}), ("4", [], {"x": "4"})]
EDGES = [("e", "1", "2", "T", {"w": "1"}), ("f", "1", "3", "T", {})]
N, E = "node_id string, labels array<string>, props map<string,string>", "edge_id string, src string, dst string, rel_type string, props map<string,string>"


@pytest.fixture(scope="module")
def tables(spark):
    return g.canonical_nodes(spark.createDataFrame(NODES, N)), g.canonical_edges(spark.createDataFrame(EDGES, E))


def test_null_is_absence(tables):
    rows = {tuple(r["labels"]): r for r in ab.node_types(tables[0]).collect()}
    assert rows[("A",)]["mandatory"] == ["x"] and rows[("A",)]["optional"] == ["z"]
    assert rows[("A", "B")]["mandatory"] == rows[("A", "B")]["optional"] == [] and () in rows


def test_unlabelled_modes(tables):
    compat, _ = ab.instance_types(*tables)
    fixed, _ = ab.instance_types(*tables, unlabelled="fixed")
    assert [""] in [r["labels"] for r in compat.collect()] and [] in [r["labels"] for r in fixed.collect()]


def test_canonical(spark):
    assert spark.range(1).select(canonical(F.array(F.lit("b"), F.lit(""), F.lit(None), F.lit("a"), F.lit("b"))).alias("c")).head()["c"] == ["a", "b"]


def test_graph_round_trip(spark, tables, tmp_path):
    for form in ("parquet", "json"):
        path = f"{tmp_path}/{form}/one"
        g.write_graph(*tables, path, form)
        back = g.scan_nodes(spark, path, form)
        assert sorted(map(str, back.collect())) == sorted(map(str, tables[0].collect())) and g.scan_edges(spark, path, form).count() == 2
        assert g.catalogue(spark, f"{tmp_path}/{form}") == ["one"]
    assert g.catalogue(spark, f"{tmp_path}/none") == []
    g.copy_graph(*tables, f"{tmp_path}/copy")
    assert all(r["props"]["__src_id"] == r["node_id"] for r in g.scan_nodes(spark, f"{tmp_path}/copy").collect())


def test_schema_graph_marks(spark):
    n = spark.createDataFrame([("a", ["A"], {"p": "mandatory", "q": "optional?", "__src_id": "7"})], N)
    e = spark.createDataFrame([("t", "a", "a", "T", {"cardinality_error": "x", "w": "opt?"})], E)
    row = g.schema_from_graph(n, e, "s").head()
    assert (row["nodes"][0]["mandatory"], row["nodes"][0]["optional"]) == (["p"], ["q"])
    assert row["edges"][0]["card_error"] and row["edges"][0]["optional"] == ["w"]
    bad = spark.createDataFrame([("t", "a", "gone", "T", {})], E)
    with pytest.raises(Exception, match="missing"):
        g.schema_from_graph(n, bad, "s").collect()


def test_query_with_parameters(spark, tables):
    assert g.query(spark, "SELECT count(*) AS n FROM nodes WHERE array_contains(labels, :l)", *tables, l="A").head()["n"] == 3


def test_type_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("T", "A", "x:y?", None, "node", True), ("T0", "A:B", "x", "T", "node", False), ("T9", "", "", None, "node", True)], "id string, labels string, properties string, subtypeof string, type string, is_basetype boolean")
    g.write_type_table(rows, f"{tmp_path}/t")
    nodes, edges = g.types_to_graph(g.read_type_table(spark, f"{tmp_path}/t"))
    assert {r["node_id"]: r["props"] for r in nodes.collect()}["T"] == {"x": "mandatory", "y": "optional?"}
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("T0", "T")] and nodes.count() == 2


DDL = """CREATE NODE TYPE personType : Person | Staff:Person {id INT, OPTIONAL email STRING};
CREATE NODE TYPE AbstractType_1 : ABSTRACT_1 {x INT};
CREATE NODE TYPE cityType : City {name STRING};
CREATE EDGE TYPE livesType : LIVES_IN | WORKS_IN {OPTIONAL since DATE};
CREATE GRAPH TYPE g STRICT {
  personType, cityType,
  (:personType)-[livesType]->(:cityType | personType)
}"""


def test_ddl_reading(spark):
    row = ddl.read_schemas(spark.createDataFrame([("s", DDL)], "schema_id string, text string")).head()
    assert [n["labels"] for n in row["nodes"]] == [["City"], ["Person"], ["Person", "Staff"]]
    assert row["nodes"][1]["mandatory"] == ["id"] and row["nodes"][1]["optional"] == ["email"]
    assert len(row["edges"]) == 2 * 2 * 3 and {e["rel_type"] for e in row["edges"]} == {"LIVES_IN", "WORKS_IN"}


def test_ddl_writing(spark, tmp_path):
    node = spark.createDataFrame([(["A"], ["x"], ["y"], {"x": "Integer", "y": "Date"}), ([], ["z"], [], {})], "labels array<string>, mandatory array<string>, optional array<string>, types map<string,string>")
    edge = spark.createDataFrame([("T", ["A"], [], [], ["w"], {"w": "Boolean"}, "N:1")], "rel_type string, src_labels array<string>, dst_labels array<string>, mandatory array<string>, optional array<string>, types map<string,string>, cardinality string")
    lines = [r["line"] for r in ddl.strict_ddl(node, edge).orderBy("place").collect()]
    assert "CREATE NODE TYPE AType : A {x INTEGER, OPTIONAL y DATE};" in lines and "CREATE NODE TYPE AbstractType_1 : ABSTRACT_1 {z STRING};" in lines
    assert "  (:AType)-[tType]->(:ABSTRACT_DST : OPEN)" in lines and any("SINGLETON y" in x for x in lines)
    text = ddl.xsd(node, edge)
    assert 'name="AType"' in text and 'type="xs:integer"' in text and 'minOccurs="0"' in text
    ddl.write_lines(ddl.loose_ddl(node, edge), f"{tmp_path}/ddl")
    assert spark.read.text(f"{tmp_path}/ddl").count() == 5


def test_type_cascade(spark):
    values = {"i": ["1", " -7 "], "d": ["1", "2147483648"], "t": ["1-URGENT", "-5x"], "b": ["true", "No"], "s": ["abc", "1"], "ip": ["10.0.0.1", "255.1.2.3"], "locationIP": ["5", "6"], "nan": ["NaN", "1e5"], "plus": ["+5.", "abc"]}
    rows = spark.createDataFrame([("k", {k: v[j] for k, v in values.items()}) for j in range(2)], "t string, props map<string,string>")
    got = {r["prop"]: r["type"] for r in inf.infer_types(rows, ["t"]).collect()}
    assert got == {"i": "Integer", "d": "Double", "t": "Date", "b": "Boolean", "s": "String", "ip": "String", "locationIP": "String", "nan": "Double", "plus": "String"}
    strict = {r["prop"]: r["type"] for r in inf.infer_types(rows, ["t"], strict_dates=True).collect()}
    assert strict["t"] == "String"


def test_cardinality(spark):
    edges = spark.createDataFrame([("1", "a", "b", "ONE", {}), ("2", "a", "b", "OUT", {}), ("3", "a", "c", "OUT", {}), ("4", "a", "b", "IN", {}), ("5", "c", "b", "IN", {}), ("6", "a", "b", "ONE", {})], E)
    got = {r["rel_type"]: r["cardinality"] for r in inf.cardinalities(edges).collect()}
    assert got == {"ONE": "1:1", "OUT": "1:N", "IN": "N:1"}
    cluster = spark.createDataFrame([("c", ["ONE", "OUT", "GONE"])], "cluster_id string, rel_types array<string>")
    assert inf.cluster_cardinality(cluster, inf.cardinalities(edges)).head()["cardinality"] == "1:1,1:N,Unknown"


def test_greedy_partition_is_first_fit(spark):
    types = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "type_id string")
    near = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.1), ("c", "d", 0.4)], "a string, b string, similarity double")
    got = {r["type_id"]: r["part"] for r in di.greedy_partition(types, near, 0.5).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1}
    keyed = spark.createDataFrame([("a", ["L"], ["x", "y"]), ("b", ["M"], ["y"]), ("c", ["L"], []), ("d", [], ["z"])], "type_id string, labels array<string>, keys array<string>")
    rows = {r["part"]: r for r in di.partition_types(keyed, di.greedy_partition(types, near, 0.5)).collect()}
    assert rows[0]["labels"] == ["L", "M"] and rows[0]["mandatory"] == [] and rows[0]["optional"] == ["x", "y"] and rows[1]["mandatory"] == ["z"]


def test_supertypes(spark):
    t = spark.createDataFrame([(["A"],), (["A", "B"],), (["A", "C"],), (["X", "Y"],), (["X", "Z"],)], "labels array<string>")
    got = {(tuple(r["child"]), tuple(r["parent"]), r["made"]) for r in di.supertypes(t).collect()}
    assert (("A", "B"), ("A",), False) in got and (("X", "Y"), ("X",), True) in got and (("A",), ("A", "B"), False) not in got
    assert any(m for c, p, m in {(tuple(r["child"]), tuple(r["parent"]), r["made"]) for r in di.supertypes(t, reuse=False).collect()} if p == ("A",))


def test_rank_statistics(spark):
    table = [("GOLDEN", "1", "2", "3", "4"), ("7", "1", "2", "3", "4"), ("8", "2", "1", "3", "4"), ("9", "1", "", "3", "4"), ("10", "1", "1", "3", "4"), ("PROPOSED", "4", "3", "2", "1")]
    wide = spark.createDataFrame(table, "name string, `Q1-1-A` string, `Q1-1-B` string, `Q1-1-C` string, `Q1-1-D` string")
    ranks = rs.unpivot(wide)
    people = ranks.where("rater not in ('GOLDEN', 'PROPOSED')")
    assert {r["item"]: r["points"] for r in rs.borda(people).collect()} == {"A": 5, "B": 5, "C": 2, "D": 0}
    best = rs.golden(people)
    assert {r["item"]: r["rank"] for r in best.collect()} == {"A": 1, "B": 2, "C": 3, "D": 4}
    assert rs.with_golden(ranks).where("rater = 'GOLDEN'").count() == 4
    taus = {r["rater"]: r["tau"] for r in rs.mean_tau(ranks, best).collect()}
    assert taus["7"] == 1 and taus["PROPOSED"] == -1 and taus["8"] == pytest.approx(4 / 6) and "9" not in taus
    same = people.where("rater = '7'").unionByName(people.where("rater = '7'").withColumn("rater", F.lit("70")))
    w = rs.kendall_w_test(same).head()
    assert w["w"] == pytest.approx(1) and w["chi2"] == pytest.approx(6) and w["df"] == 3 and w["p"] == pytest.approx(0.111610, abs=1e-6)


@pytest.mark.parametrize(("x", "df", "p"), [(3.84146, 1, 0.05), (5.99146, 2, 0.05), (7.81473, 3, 0.05), (9.48773, 4, 0.05), (11.0705, 5, 0.05), (18.307, 10, 0.05), (30.0, 3, 1.3801e-06), (0.0, 3, 1.0)])
def test_chi_square(spark, x, df, p):
    got = spark.range(1).select(rs.chi_square_tail(F.lit(x), F.lit(df)).alias("p")).head()["p"]
    assert got == pytest.approx(p, rel=1e-4)


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 2.5, 3.5])
def test_erfc(spark, z):
    assert spark.range(1).select(rs.erfc(F.lit(z)).alias("v")).head()["v"] == pytest.approx(math.erfc(z), rel=1e-7)


def test_majority(spark):
    rows = spark.createDataFrame([("1", "a", 3), ("1", "b", 1), ("2", "b", 2), ("3", "a", 1), ("3", "c", 1)], "cluster_id string, label string, n long")
    got = ev.majority_scores(rows).head()
    assert (got["tp"], got["fp"], got["fn"]) == (6, 2, 2)


def test_error_kinds_change_what_they_say():
    def fresh():
        n = [{"type_id": t, "labels": ["L" + t, "M"], "mandatory": ["p", "q"], "optional": ["r"]} for t in "ab"]
        return n, [{"edge_id": "e", "rel_type": "T", "mandatory": ["w"], "optional": [], "src_type": "a", "dst_type": "b", "card_error": False}]

    for kind in ij.KINDS:
        one, two = fresh(), fresh()
        ij.inject(*one, kind, 1, True, 42, 0)
        assert one != two, kind
        again = fresh()
        ij.inject(*again, kind, 1, True, 42, 0)
        assert again == one
    n, e = fresh()
    ij.inject(n, e, "edge_cardinality_error", 3, False, 42, 0)
    assert not e[0]["card_error"]
    ij.inject(n, e, "node_type_missing", 9, True, 42, 0)
    assert n == [] and e == []
    n, _ = fresh()
    ij.remove_share(n, 5, 42, 0)
    assert sum(len(t["mandatory"]) + len(t["optional"]) for t in n) == 3


def test_pages_and_paths(spark, tables):
    rows = spark.range(95).select(F.format_string("n%05d", "id").alias("k"))
    got = pa.pages(rows, "k", 10).groupBy("page").agg(F.count("*").alias("n"), F.min("k").alias("a")).orderBy("page").collect()
    assert [r["n"] for r in got] == [10] * 9 + [5] and got[3]["a"] == "n00030"
    assert pa.optional_degree(*tables, "A", "T").where("degree = 2").count() == 1
    assert pa.expand(tables[1], tables[0].where("node_id <> '3'"), optional=True).count() == 2


def test_stream_counts_are_exact(spark, tmp_path, tables):
    source = f"{tmp_path}/in"
    tables[0].repartition(3).write.json(source)
    stream = spark.readStream.schema(N).option("maxFilesPerTrigger", 1).json(source)
    seen = []
    q = inc.stream_batches(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda m: seen.append(m.count()))
    q.processAllAvailable()
    q.stop()
    got = inc.types(inc.merged(spark.read.parquet(f"{tmp_path}/out")))
    want = ab.node_types(tables[0])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and seen
    live = inc.stream_counts(stream, "live_counts")
    live.processAllAvailable()
    assert sorted(map(str, inc.types(spark.table("live_counts")).collect())) == sorted(map(str, want.collect()))
    live.stop()
    parts = [inc.counts(tables[0].where(c)) for c in ("node_id < '3'", "node_id >= '3'")]
    assert sorted(map(str, inc.types(inc.merge(*parts)).collect())) == sorted(map(str, want.collect()))


def test_windowed_drift(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(t, "a", '{"k": 1}'), (t, "a", "{}"), (t + datetime.timedelta(days=1), "a", '{"k": 1, "l": 2}')], "ts timestamp, event_type string, props string")
    got = {(r["start"].day, r["key"]): r["n"] for r in inc.drift(rows).collect()}
    assert got == {(1, ""): 2, (1, "k"): 1, (2, ""): 1, (2, "k"): 1, (2, "l"): 1}


def test_merge_discovered(spark):
    one = spark.createDataFrame([(["A"], 3, ["x", "y"], [])], "labels array<string>, members long, mandatory array<string>, optional array<string>")
    two = spark.createDataFrame([(["A"], 2, ["x"], ["z"])], one.schema)
    row = inc.merge_discovered(one, two).head()
    assert (row["members"], row["mandatory"], row["optional"]) == (5, ["x"], ["y", "z"])


def test_lsh_parameters():
    assert lsh_parameters(None, 10, 2) == (0.2, 15) and lsh_parameters(1.0, 10**9, 20, edges=True) == (1.2, 9)
    assert lsh_parameters(1.0, 10**12, 2)[1] == 18


def test_trials_are_rows(spark):
    made = ij.trials(schemas(spark, Schema("s", {"a": (["A"], ["x"])}, [])), kinds=("node_duplicate", "edge_random"), levels=(1,), n=4)
    rows = made.collect()
    assert len(rows) == 8 and all(len(r["nodes"]) == (2 if r["kind"] == "node_duplicate" else 1) for r in rows)
