"""DDL of every shape: no properties, names of several labels, signs in names, relationship types with several ends."""

from strandgraph.sources import ddl

SHAPES = """-- NODE TYPES --
CREATE NODE TYPE SetType : Set;
CREATE NODE TYPE Soft:ServiceType : Soft:Service {name STRING, OPTIONAL ports DATE};
CREATE NODE TYPE ORG/GOV_PRODUCTType : ORG/GOV | PRODUCT {id INTEGER};
CREATE NODE TYPE App:Art&Design_AppType : App:Art&Design | App;
CREATE NODE TYPE PlainType: Plain {};

-- EDGE TYPES --
CREATE EDGE TYPE has_setType : HAS_SET;
CREATE EDGE TYPE runs_usesType : RUNS | USES {OPTIONAL since DATE};

CREATE GRAPH TYPE NewGraphSchema STRICT {
  (SetType),
  (Soft:ServiceType),
  (:Soft:ServiceType)-[has_setType]->(:SetType),
  (:ORG/GOV_PRODUCTType|App:Art&Design_AppType)-[runs_usesType]->(:Soft:ServiceType),
}
"""


def test_every_shape_is_read(spark):
    texts = spark.createDataFrame([("s", SHAPES)], "schema_id string, text string")
    nodes, edges, joins = ddl.parse(texts)
    assert nodes.count() == 5 and edges.count() == 2 and joins.count() == 2
    row = ddl.read_schemas(texts).head()
    found = {tuple(n["labels"]): (n["mandatory"], n["optional"]) for n in row["nodes"]}
    assert found == {
        ("Set",): ([], []), ("Service", "Soft"): (["name"], ["ports"]), ("ORG/GOV",): (["id"], []), ("PRODUCT",): (["id"], []),
        ("App", "Art&Design"): ([], []), ("App",): ([], []), ("Plain",): ([], []),
    }
    assert {(e["rel_type"], e["src_type"], e["dst_type"]) for e in row["edges"]} == {("HAS_SET", "Service:Soft", "Set")} | {
        (r, s, "Service:Soft") for r in ("RUNS", "USES") for s in ("ORG/GOV", "PRODUCT", "App:Art&Design", "App")
    }


def test_ends_of_one_relationship_type_are_united(spark):
    node = spark.createDataFrame([(["A"], [], [], {}), (["B"], ["x"], [], {"x": "Integer"})], "labels array<string>, mandatory array<string>, optional array<string>, types map<string,string>")
    ends = [("R", ["A"], ["B"], ["k", "p"], [], {"k": "Integer", "p": "Date"}, "N:N"), ("R", ["B"], ["A"], ["k", "q"], ["z"], {"k": "Integer", "q": "Double", "z": "String"}, "N:N")]
    edge = spark.createDataFrame(ends, "rel_type string, src_labels array<string>, dst_labels array<string>, mandatory array<string>, optional array<string>, types map<string,string>, cardinality string")
    lines = [r["line"] for r in ddl.strict_ddl(node, edge).orderBy("place").collect()]
    assert [x for x in lines if x.startswith("CREATE EDGE")] == ["CREATE EDGE TYPE rType : R {k INTEGER, OPTIONAL p DATE, OPTIONAL q DOUBLE, OPTIONAL z STRING};"]
    assert "  (AType)," in lines and "  (:BType)-[rType]->(:AType)" in lines
    row = ddl.read_schemas(spark.createDataFrame([("s", chr(10).join(lines))], "schema_id string, text string")).head()
    assert [n["labels"] for n in row["nodes"]] == [["A"], ["B"]] and len(row["edges"]) == 2
    assert all(e["mandatory"] == ["k"] and e["optional"] == ["p", "q", "z"] for e in row["edges"])
