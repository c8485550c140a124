"""Graph-type DDL: written from type tables, and read back as schemas.

Types are few, so the text is put together from rows with column expressions and
written as one file; reading takes whole files and extracts by regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE, NODE

#: Names of types in DDL, others are STRING.
NAMES = {"string": "STRING", "int": "INT", "int32": "INT32", "integer": "INTEGER", "date": "DATE", "double": "DOUBLE", "boolean": "BOOLEAN"}
XSD = {"string": "xs:string", "integer": "xs:integer", "int": "xs:integer", "double": "xs:double", "date": "xs:date", "boolean": "xs:boolean"}


def _name(kind: Column, names: dict[str, str], other: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[F.lower(kind)], F.lit(other))


def property_list(mandatory: Column, optional: Column, types: Column, marked: bool = True) -> Column:
    """``a STRING, OPTIONAL b DATE``: types is a map from property to type."""
    one = lambda p: F.concat_ws(" ", p, _name(types[p], NAMES, "STRING"))
    rest = F.transform(optional, lambda p: F.concat(F.lit("OPTIONAL " if marked else ""), one(p)))
    return F.array_join(F.concat(F.transform(mandatory, one), rest), ", ")


def node_names(types: DataFrame) -> DataFrame:
    """types (labels, mandatory, optional, types) with type_name and label_text; unlabelled ones are numbered."""
    n = F.row_number().over(Window.partitionBy(F.size("labels") == 0).orderBy(F.array_join("mandatory", ","), F.array_join("optional", ",")))
    bare = F.size("labels") == 0
    name = F.when(bare, F.concat(F.lit("AbstractType_"), n)).otherwise(F.concat(F.array_join("labels", "_"), F.lit("Type")))
    text = F.when(bare, F.concat(F.lit("ABSTRACT_"), n)).otherwise(F.array_join("labels", " | "))
    return types.withColumn("type_name", name).withColumn("label_text", text)


def node_ddl(types: DataFrame) -> DataFrame:
    t = node_names(types)
    line = F.concat(F.lit("CREATE NODE TYPE "), F.col("type_name"), F.lit(" : "), F.col("label_text"), F.lit(" {"), property_list(F.col("mandatory"), F.col("optional"), F.col("types")), F.lit("};"))
    return t.select("type_name", line.alias("line"))


def edge_names(types: DataFrame) -> DataFrame:
    return types.withColumn("type_name", F.concat(F.lower("rel_type"), F.lit("Type")))


def united(types: DataFrame) -> DataFrame:
    """type_name, rel_type, mandatory, optional, types: one row a relationship type, mandatory what all its ends have."""
    every = edge_names(types).groupBy("type_name", "rel_type").agg(
        F.collect_list("mandatory").alias("m"), F.collect_list("optional").alias("o"), F.flatten(F.collect_list(F.map_entries("types"))).alias("t")
    )
    shared = F.array_sort(F.aggregate("m", F.col("m")[0], F.array_intersect))
    keys = F.array_distinct(F.flatten(F.concat("m", "o")))
    kind = lambda p: F.array_min(F.transform(F.filter("t", lambda e: e["key"] == p), lambda e: e["value"]))
    kinds = F.map_from_entries(F.transform(keys, lambda p: F.struct(p, kind(p))))
    return every.select("type_name", "rel_type", shared.alias("mandatory"), F.array_sort(F.array_except(keys, shared)).alias("optional"), kinds.alias("types"))


def edge_ddl(types: DataFrame) -> DataFrame:
    """An edge type line for each relationship type, with the keys of all its ends."""
    line = F.concat(F.lit("CREATE EDGE TYPE "), F.col("type_name"), F.lit(" : "), F.col("rel_type"), F.lit(" {"), property_list(F.col("mandatory"), F.col("optional"), F.col("types")), F.lit("};"))
    return united(types).select("type_name", line.alias("line"))


def connections(types: DataFrame) -> DataFrame:
    """type_name, line: (:Source)-[typeName]->(:Destination), blank ends ABSTRACT and open."""
    end = lambda labels, bare: F.when(F.size(labels) == 0, F.lit(f"ABSTRACT_{bare} : OPEN")).otherwise(F.concat(F.array_join(labels, "_"), F.lit("Type")))
    line = F.concat(F.lit("  (:"), end("src_labels", "SRC"), F.lit(")-["), F.col("type_name"), F.lit("]->(:"), end("dst_labels", "DST"), F.lit(")"))
    return edge_names(types).select("type_name", line.alias("line")).distinct()


def constraints(types: DataFrame) -> DataFrame:
    """Cardinality constraints: 1:1 both ends, N:1 and 1:N one, else none."""
    side = lambda labels: F.concat(F.array_join(labels, "_"), F.lit("Type"))
    path = F.concat(F.lit("(x:"), side("src_labels"), F.lit(")-[:"), F.col("type_name"), F.lit("]->(y:"), side("dst_labels"), F.lit(")"))
    of = lambda x, y: F.concat(F.lit(f"FOR ({x}:"), side("src_labels" if x == "x" else "dst_labels"), F.lit(f") SINGLETON {y} WITHIN "), path, F.lit(";"))
    line = F.when(F.col("cardinality") == "1:1", of("x", "x,y")).when(F.col("cardinality") == "N:1", of("x", "y")).when(F.col("cardinality") == "1:N", of("y", "x"))
    return edge_names(types).select("type_name", line.alias("line")).where("line is not null").distinct()


def strict_ddl(node_types: DataFrame, edge_types: DataFrame, graph: str = "NewGraphSchema") -> DataFrame:
    """place, line: node types, edge types, the strict graph type, then constraints.

    node_types: labels, mandatory, optional, types (map); edge_types: rel_type,
    src_labels, dst_labels, mandatory, optional, types, cardinality.
    """
    spark = node_types.sparkSession
    fixed = lambda k, text: spark.createDataFrame([(k, "", text)], "part int, type_name string, line string")
    part = lambda k, df: df.select(F.lit(k).alias("part"), "type_name", "line")
    body = node_ddl(node_types).select("type_name", F.concat(F.lit("  ("), "type_name", F.lit("),")).alias("line"))
    rows = part(1, node_ddl(node_types)).unionByName(part(2, edge_ddl(edge_types))).unionByName(fixed(3, f"CREATE GRAPH TYPE {graph} STRICT {{"))
    rows = rows.unionByName(part(4, body)).unionByName(part(5, connections(edge_types))).unionByName(fixed(6, "}"))
    rows = rows.unionByName(part(7, constraints(edge_types)))
    last = F.row_number().over(Window.orderBy("part", "type_name", "line"))
    return rows.select(last.alias("place"), "line")


def loose_ddl(node_types: DataFrame, edge_types: DataFrame, graph: str = "NewGraphSchema") -> DataFrame:
    """place, line: one CREATE GRAPH TYPE ... LOOSE block; properties are not marked."""
    spark = node_types.sparkSession
    fixed = lambda k, text: spark.createDataFrame([(k, text)], "part int, line string")
    props = property_list(F.col("mandatory"), F.col("optional"), F.col("types"), marked=False)
    nodes = node_names(node_types).select(F.lit(1).alias("part"), F.concat(F.lit("  ("), F.col("type_name"), F.lit(" : "), F.col("label_text"), F.lit(" {"), props, F.lit("})")).alias("line"))
    end = lambda labels, bare: F.when(F.size(labels) == 0, F.lit(f"ABSTRACT_{bare}")).otherwise(F.concat(F.array_join(labels, "_"), F.lit("Type")))
    edges = edge_names(edge_types).select(F.lit(2).alias("part"), F.concat(F.lit("  (:"), end("src_labels", "SRC"), F.lit(")-["), F.col("type_name"), F.lit(" : "), F.col("rel_type"), F.lit(" {"), props, F.lit("}]->(:"), end("dst_labels", "DST"), F.lit(")")).alias("line")).distinct()
    rows = fixed(0, f"CREATE GRAPH TYPE {graph} LOOSE {{").unionByName(nodes).unionByName(edges).unionByName(fixed(3, "}"))
    return rows.select(F.row_number().over(Window.orderBy("part", "line")).alias("place"), "line")


def xsd_elements(node_types: DataFrame, edge_types: DataFrame) -> DataFrame:
    """name, kind, prop, xsd_type, min_occurs: the parts of an XML schema, a row a property ('' for a type without)."""
    def rows(df: DataFrame, name: Column, kind: str) -> DataFrame:
        both = df.select(name.alias("name"), "types", F.explode_outer(F.concat(F.transform("mandatory", lambda p: F.struct(p.alias("prop"), F.lit(1).alias("min_occurs"))), F.transform("optional", lambda p: F.struct(p.alias("prop"), F.lit(0).alias("min_occurs"))))).alias("p"))
        got = both.groupBy("name", F.coalesce("p.prop", F.lit("")).alias("prop")).agg(F.min("p.min_occurs").alias("min_occurs"), F.min(F.col("types")[F.col("p.prop")]).alias("t"))
        return got.select("name", F.lit(kind).alias("kind"), "prop", _name(F.col("t"), XSD, "xs:string").alias("xsd_type"), F.coalesce("min_occurs", F.lit(1)).alias("min_occurs"))

    first = F.coalesce(F.get("labels", F.lit(0)), F.lit("Abstract"))
    return rows(node_types, first, "node").unionByName(rows(edge_types, F.col("rel_type"), "edge"))


def xsd(node_types: DataFrame, edge_types: DataFrame) -> str:
    """The XML schema as text; types are a handful of rows."""
    from xml.etree import ElementTree as ET

    space = "http://www.w3.org/2001/XMLSchema"
    ET.register_namespace("xs", space)
    root = ET.Element(f"{{{space}}}schema")
    sequences: dict[tuple[str, str], ET.Element] = {}
    for r in xsd_elements(node_types, edge_types).orderBy("kind", "name", "prop").collect():
        if (r["kind"], r["name"]) not in sequences:
            element = ET.SubElement(root, f"{{{space}}}complexType", name=r["name"] + ("Type" if r["kind"] == "node" else "EdgeType"))
            sequences[r["kind"], r["name"]] = ET.SubElement(element, f"{{{space}}}sequence")
        if r["prop"]:
            ET.SubElement(sequences[r["kind"], r["name"]], f"{{{space}}}element", name=r["prop"], type=r["xsd_type"], minOccurs=str(r["min_occurs"]))
    return ET.tostring(root, encoding="unicode")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


# --- reading ----------------------------------------------------------------
#: A name ends at a colon with blanks on both sides, as names may hold colons; a plain name may go without them.
_NAMED = r"\s+TYPE\s+(\S+(?=\s+:\s)|\w+)\s*:\s*([^{};]+?)\s*(?:\{([^}]*)\}|(?=;))"
NODE_LINE, EDGE_LINE = r"CREATE\s+NODE" + _NAMED, r"CREATE\s+EDGE" + _NAMED
CONNECTION = r"\(\s*:\s*([^)]*?)\s*\)\s*-\[\s*([^\]\s]+)\s*\]->\s*\(\s*:\s*([^)]*?)\s*\)"


def _groups(text: Column, pattern: str, n: int = 3) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)) for k in range(n)]
    return F.explode(F.arrays_zip(*(p.alias(f"g{k}") for k, p in enumerate(parts))))


def _props(text: Column, optional: bool) -> Column:
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    marked = lambda x: x.rlike("(?i)^OPTIONAL\\s")
    chosen = F.filter(items, lambda x: marked(x) if optional else ~marked(x))
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda x: F.regexp_extract(x, r"^(?:(?i:OPTIONAL)\s+)?(\S+)", 1))))


def alternatives(text: Column) -> Column:
    """The label sets of ``A:B | C``: an array of sorted arrays, abstract ones left out."""
    sets = F.transform(F.split(text, "\\|"), lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(a, ":"), lambda x: F.trim(x)), lambda x: x != ""))))
    return F.filter(sets, lambda s: (F.size(s) > 0) & ~F.exists(s, lambda x: x.rlike("^ABSTRACT")))


def parse(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node types, edge types and connections of (schema_id, text)."""
    flat = lambda p: texts.select("schema_id", _groups(F.col("text"), p).alias("g"))
    nodes = flat(NODE_LINE).select("schema_id", F.col("g.g0").alias("type_name"), alternatives(F.col("g.g1")).alias("label_sets"), _props(F.col("g.g2"), False).alias("mandatory"), _props(F.col("g.g2"), True).alias("optional"))
    rels = F.filter(F.transform(F.split(F.col("g.g1"), "[|:]"), lambda x: F.trim(x)), lambda x: x != "")
    edges = flat(EDGE_LINE).select("schema_id", F.col("g.g0").alias("type_name"), rels.alias("rel_types"), _props(F.col("g.g2"), False).alias("mandatory"), _props(F.col("g.g2"), True).alias("optional"))
    joins = flat(CONNECTION).select("schema_id", F.col("g.g1").alias("edge_name"), F.transform(F.split("g.g0", "\\|"), lambda x: F.trim(x)).alias("src"), F.transform(F.split("g.g2", "\\|"), lambda x: F.trim(x)).alias("dst")).distinct()
    return nodes, edges, joins


def read_schemas(texts: DataFrame) -> DataFrame:
    """Schema rows of DDL texts: a node type for each alternative, an edge type for each relationship type and pair of ends.

    Of several definitions of one label set the first by type name counts.
    """
    nodes, edges, joins = parse(texts)
    alone = nodes.select("schema_id", "type_name", F.explode("label_sets").alias("labels"), "mandatory", "optional")
    first = F.row_number().over(Window.partitionBy("schema_id", "labels").orderBy("type_name"))
    kept = alone.withColumn("r", first).where("r = 1")
    tid = F.array_join("labels", ":")
    n = kept.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct(tid.alias("type_id"), "labels", "mandatory", "optional"))).alias("nodes"))
    names = alone.select("schema_id", F.col("type_name").alias("name"), tid.alias("type_id")).distinct()
    placed = joins.join(edges.withColumnRenamed("type_name", "edge_name"), ["schema_id", "edge_name"]).select("schema_id", "edge_name", "mandatory", "optional", F.explode("rel_types").alias("rel_type"), "src", "dst")
    placed = placed.select("*", F.explode("src").alias("s")).select("*", F.explode("dst").alias("d"))
    end = lambda c: names.select("schema_id", F.col("name").alias(c), F.col("type_id").alias(f"{c}_type"))
    once = F.row_number().over(Window.partitionBy("schema_id", "rel_type", "s_type", "d_type").orderBy("edge_name", "s", "d"))
    placed = placed.join(end("s"), ["schema_id", "s"]).join(end("d"), ["schema_id", "d"]).withColumn("_once", once).where("_once = 1")
    edge = F.struct(F.concat_ws("|", "s_type", "rel_type", "d_type").alias("edge_id"), "rel_type", "mandatory", "optional", F.col("s_type").alias("src_type"), F.col("d_type").alias("dst_type"), F.lit(False).alias("card_error"))
    e = placed.groupBy("schema_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return n.join(e, "schema_id", "left").select("schema_id", F.col("nodes").cast(f"array<{NODE}>").alias("nodes"), F.coalesce(F.col("edges").cast(f"array<{EDGE}>"), F.array().cast(f"array<{EDGE}>")).alias("edges"))
