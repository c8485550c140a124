"""Scores worked out by hand from the definitions, and metamorphic properties."""

import pytest
from pyspark.sql import functions as F

from strandgraph.functions.similarity import Weights
from strandgraph.model import EDGE, Schema, schemas
from strandgraph.operators.abstraction import instance_types
from strandgraph.operators.flatten import flat
from strandgraph.operators.scoring import edge_concision_top2, schema_f1, score

U, P = (["User"], ["id", "name"]), (["Post"], ["id", "text"])
EXACT = Schema("exact", {"u": U, "p": P}, [("c", "CREATES", "u", "p", []), ("f", "FOLLOWS", "u", "u", [])])
NO_NAME = Schema("no_name", {"u": (["User"], ["id"]), "p": P}, EXACT.edges)
TWIN = Schema("twin", {"u": U, "v": U, "p": P}, [("c", "CREATES", "u", "p", []), ("f", "FOLLOWS", "u", "u", []), ("g", "FOLLOWS", "v", "v", [])])
LIKES = Schema("likes", {"u": U, "p": P}, [*EXACT.edges, ("l", "LIKES", "u", "p", [])])


def graph(spark, posts=3):
    nodes = [(f"u{i}", ["User"], {"id": "1", "name": "n"}) for i in range(3)] + [(f"p{i}", ["Post"], {"id": "1", "text": "t"}) for i in range(posts)]
    edges = [(f"c{i}", f"u{i}", f"p{i}", "CREATES", {}) for i in range(posts)] + [("f", "u0", "u1", "FOLLOWS", {})]
    return spark.createDataFrame(nodes, "node_id string, labels array<string>, props map<string,string>"), spark.createDataFrame(edges, "edge_id string, src string, dst string, rel_type string, props map<string,string>")


@pytest.fixture(scope="module")
def results(spark):
    inst = instance_types(*graph(spark))
    rows = score(schemas(spark, EXACT, NO_NAME, TWIN, LIKES, Schema("none")), *inst).collect()
    return {r["schema_id"]: [round(r[c], 6) for c in ("node_coverage", "edge_coverage", "node_concision", "edge_concision", "node_c2", "edge_c2")] for r in rows}


def test_exact(results):
    assert results["exact"] == [1, 1, 1, 1, 1, 1]


def test_missing_property(results):
    assert results["no_name"][:4] == [0.958333, 0.96875, 1, 1]
    assert results["no_name"][4:] == [0.978723, 0.984127]


def test_duplicate_type(results):
    assert results["twin"][3] == 0.333333 and results["twin"][5] == 0.5


def test_extra_edge_type(results):
    assert results["likes"] == [1, 1, 1, 0.666667, 1, 0.8]


def test_empty_schema(results):
    assert results["none"][:4] == [0, 0, 1, 1]


def test_top2_agrees(spark):
    inst = instance_types(*graph(spark))
    given = schemas(spark, EXACT, NO_NAME, TWIN, LIKES)
    top = {r[0]: round(r[1], 9) for r in edge_concision_top2(given, *inst).collect()}
    plain = {r["schema_id"]: round(r["edge_concision"], 9) for r in score(given, *inst).collect()}
    assert top == plain


def test_inheritance(spark):
    official = Schema("x", {"u": U, "o": (["Official"], []), "p": P}, [("e", "EXTENDS", "o", "u", []), ("c", "CREATES", "u", "p", []), ("f", "FOLLOWS", "u", "u", [])])
    row = schemas(spark, official).head()
    nodes, edges = flat([n.asDict() for n in row["nodes"]], [e.asDict() for e in row["edges"]])
    assert {n["type_id"]: n["labels"] for n in nodes}["o"] == ["Official", "User"]
    assert len(edges) == 2 + 4  # CREATES from both; FOLLOWS over the clan
    written = Schema("w", {n["type_id"]: (n["labels"], [*n["mandatory"], *(p + "?" for p in n["optional"])]) for n in nodes}, [(f"e{k}", e["rel_type"], e["src_type"], e["dst_type"], []) for k, e in enumerate(edges)])
    given = schemas(spark, official).withColumn("truth_id", F.lit("w"))
    f1 = schema_f1(given, schemas(spark, written)).head()
    assert f1["node_f1"] == f1["edge_f1"] == 1.0
    again_nodes, again_edges = flat([n.asDict() for n in schemas(spark, written).head()["nodes"]], [e.asDict() for e in schemas(spark, written).head()["edges"]])
    assert (len(again_nodes), len(again_edges)) == (len(nodes), len(edges))


def test_cycle_is_own_ancestor(spark):
    ring = Schema("r", {"a": (["A"], ["x"]), "b": (["B"], ["y?"])}, [("1", "EXTENDS", "a", "b", []), ("2", "EXTENDS", "b", "a", [])])
    row = schemas(spark, ring).head()
    nodes, _ = flat([n.asDict() for n in row["nodes"]], [e.asDict() for e in row["edges"]])
    assert all(n["labels"] == ["A", "B"] and n["mandatory"] == ["x"] and n["optional"] == ["y"] for n in nodes)


def test_own_abstraction_covers(spark):
    nodes, edges = graph(spark)
    inst = instance_types(nodes, edges)
    own = Schema("own", {"u": U, "p": P}, EXACT.edges)
    r = score(schemas(spark, own), *inst, Weights(label=0.6, mandatory=0.2, optional=0.2)).head()
    assert r["node_coverage"] == pytest.approx(1) and r["edge_coverage"] == pytest.approx(1)


def test_weights_must_sum():
    with pytest.raises(ValueError):
        Weights(label=0.9)
    with pytest.raises(ValueError):
        Schema("bad", {}, [("e", "T", "x", "y", [])]).row()
    assert "rel_type" in EDGE
