"""The registered graph queries, each with its DuckDB form where SQL can express it.

Sets are given as joined strings and doubles rounded to six places, so that both
engines' results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import Weights, bigram_dice, dice, jaccard
from ..model import joined, present, schemas
from ..operators import abstraction as ab
from ..operators import clustering as cl
from ..operators import discovery as di
from ..operators import evaluate as ev
from ..operators import flatten as fl
from ..operators import inference as inf
from ..operators import inject as ij
from ..operators import patterns as pa
from ..operators import rank_stats as rs
from ..operators import scoring as sc
from ..sources import ddl
from ..sources.graph import schema_from_graph, schema_to_graph
from ..sources.tables import edges, nodes, table
from ..streaming import incremental as inc
from . import candidates as c
from .sql import SCORE, flattened, graph, scored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def names(*columns: str, by: str = ",") -> list[Column]:
    return [joined(F.col(x), by).alias(x) for x in columns]


# --- abstraction ------------------------------------------------------------
@query(graph("SELECT array_to_string(labels, ':') AS labels, n, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM nt", True))
def node_type_abstraction(spark, d):
    return ab.node_types(nodes(spark, d)).select(*names("labels", by=":"), "n", *names("mandatory", "optional"))


@query(graph("SELECT array_to_string(sl, ':') AS src_labels, rel AS rel_type, array_to_string(dl, ':') AS dst_labels, n, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM et", True))
def edge_type_abstraction(spark, d):
    return ab.edge_types(edges(spark, d), nodes(spark, d)).select(*names("src_labels", "dst_labels", by=":"), "rel_type", "n", *names("mandatory", "optional"))


@query(graph("SELECT array_to_string(labels, ':') AS labels, count(*) AS n FROM nodes GROUP BY 1"))
def label_set_counts(spark, d):
    return nodes(spark, d).groupBy(joined(F.col("labels"), ":").alias("labels")).agg(F.count("*").alias("n"))


@query(graph("SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY 1"))
def label_counts(spark, d):
    return nodes(spark, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(graph("SELECT array_to_string(labels, ':') AS labels, array_to_string(keys, ',') AS keys, count(*) AS n FROM nkeys GROUP BY 1, 2"))
def label_key_set_counts(spark, d):
    return ab.node_patterns(nodes(spark, d)).select(*names("labels", by=":"), *names("keys"), "n")


@query(graph("""SELECT k AS key, count(*) AS n, any_value(t) AS total, count(*) = any_value(t) AS mandatory
FROM np JOIN nodes USING (node_id), (SELECT count(*) AS t FROM nodes WHERE list_contains(labels, 'Customer')) WHERE list_contains(labels, 'Customer') GROUP BY 1"""))
def key_frequency_by_label(spark, d):
    return ab.label_profile(nodes(spark, d), "Customer")


@query(graph("""SELECT k AS key, count(*) AS n, any_value(t) AS total, count(*) = any_value(t) AS mandatory
FROM ep JOIN edges USING (eid), (SELECT count(*) AS t FROM edges WHERE rel = 'HAS_LINE') WHERE rel = 'HAS_LINE' GROUP BY 1"""))
def edge_property_profile(spark, d):
    return ab.type_profile(edges(spark, d), "HAS_LINE")


KIND = "CASE WHEN regexp_matches(v, '^-?(0|[1-9][0-9]*)$') THEN 'int' WHEN regexp_matches(v, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') THEN 'float' WHEN lower(v) IN ('true', 'false') THEN 'bool' ELSE 'str' END"


@query(graph(f"""SELECT array_to_string(labels, ':') AS labels, k AS key, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds, count(*) AS n,
count(*) <> max(count(*)) OVER (PARTITION BY labels) AS optional FROM (SELECT labels, k, {KIND} AS kind FROM nodes JOIN np USING (node_id)) GROUP BY labels, k"""))
def prop_mandatory_by_max_freq(spark, d):
    return ab.property_kinds(nodes(spark, d)).select(*names("labels", by=":"), "key", "kinds", "n", "optional")


@query(graph(f"SELECT k AS key, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds, count(*) AS n FROM (SELECT k, {KIND} AS kind FROM np) GROUP BY 1"))
def property_type_union(spark, d):
    rows = ab.property_kinds(nodes(spark, d)).select("key", "n", F.explode(F.split("kinds", "\\+")).alias("kind"), "labels")
    n = rows.dropDuplicates(["key", "labels"]).groupBy("key").agg(F.sum("n").alias("n"))
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds")).join(n, "key")


SIGS = """sigs AS (SELECT eid, src, dst, rel || ':' || array_to_string(keys, ',') AS sig FROM ekeys),
st AS (
  SELECT labels, keys, inc, out, count(*) AS n FROM (
    SELECT n.labels, n.keys, coalesce(i.s, []) AS inc, coalesce(o.s, []) AS out FROM nkeys AS n
    LEFT JOIN (SELECT dst, list_sort(list(DISTINCT sig)) AS s FROM sigs GROUP BY 1) AS i ON i.dst = n.node_id
    LEFT JOIN (SELECT src, list_sort(list(DISTINCT sig)) AS s FROM sigs GROUP BY 1) AS o ON o.src = n.node_id) GROUP BY ALL),
se AS (SELECT e.rel, e.keys, a.labels AS sl, a.keys AS sk, b.labels AS dl, b.keys AS dk, count(*) AS n FROM ekeys AS e JOIN nkeys AS a ON a.node_id = e.src JOIN nkeys AS b ON b.node_id = e.dst GROUP BY ALL),
freq AS (
  SELECT kind, name, count(*) AS n FROM (
    SELECT 'label' AS kind, unnest(labels) AS name FROM st UNION ALL SELECT 'prop', unnest(keys) FROM st
    UNION ALL SELECT 'label', rel FROM se UNION ALL SELECT 'prop', unnest(keys) FROM se) GROUP BY 1, 2)"""


@query(graph("SELECT array_to_string(labels, ':') AS labels, array_to_string(keys, ',') AS keys, array_to_string(inc, ' ') AS incoming, array_to_string(out, ' ') AS outgoing, n FROM st", extra=SIGS))
def structural_node_types(spark, d):
    return ab.structural_node_types(nodes(spark, d), edges(spark, d)).select(*names("labels", by=":"), *names("keys"), *names("incoming", "outgoing", by=" "), "n")


@query(graph("SELECT rel AS rel_type, array_to_string(keys, ',') AS keys, array_to_string(sl, ':') AS src_labels, array_to_string(sk, ',') AS src_keys, array_to_string(dl, ':') AS dst_labels, array_to_string(dk, ',') AS dst_keys, n FROM se", extra=SIGS))
def structural_edge_types(spark, d):
    return ab.structural_edge_types(edges(spark, d), nodes(spark, d)).select("rel_type", *names("keys", "src_keys", "dst_keys"), *names("src_labels", "dst_labels", by=":"), "n")


@query(graph("SELECT * FROM freq", extra=SIGS))
def attribute_frequency(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return ab.attribute_frequency(ab.structural_node_types(n, e), ab.structural_edge_types(e, n))


@query(graph("""SELECT kind, word, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, word) AS INTEGER) AS place FROM (
SELECT 'label' AS kind, word, count(*) AS n FROM (SELECT unnest(labels) AS word FROM nodes) GROUP BY 2 UNION ALL SELECT 'prop', k, count(*) FROM np GROUP BY 2)"""))
def ranked_words(spark, d):
    return ab.ranked_words(nodes(spark, d))


# --- patterns ---------------------------------------------------------------
@query(graph("SELECT node_id, array_to_string(labels, ':') AS labels FROM nodes WHERE list_contains(labels, 'Customer')"))
def nodes_with_label(spark, d):
    return pa.with_label(nodes(spark, d), "Customer").select("node_id", *names("labels", by=":"))


@query(graph("SELECT node_id FROM nodes WHERE labels = ['Customer', 'Debtor']"))
def nodes_exact_label(spark, d):
    return pa.with_label_set(nodes(spark, d), ["Debtor", "Customer"]).select("node_id")


@query(graph("SELECT src, dst FROM edges WHERE rel = 'LIVES_IN'"))
def edges_of_type(spark, d):
    return pa.of_type(edges(spark, d), "LIVES_IN").select("src", "dst")


@query(graph("SELECT DISTINCT node_id FROM np WHERE k = 'priority'"))
def property_exists(spark, d):
    return pa.has_property(nodes(spark, d), "priority").select("node_id")


@query(graph("SELECT node_id FROM np WHERE k = 'mktsegment' AND v = 'BUILDING'"))
def property_equals(spark, d):
    return pa.property_is(nodes(spark, d), "mktsegment", "BUILDING").select("node_id")


@query(graph("SELECT e.src, e.dst FROM edges AS e JOIN nodes AS a ON a.node_id = e.src JOIN nodes AS b ON b.node_id = e.dst WHERE rel = 'HAS_ORDER' AND list_contains(a.labels, 'Debtor') AND list_contains(b.labels, 'Fulfilled')"))
def endpoint_pattern(spark, d):
    return pa.match(edges(spark, d), nodes(spark, d), "Debtor", "HAS_ORDER", "Fulfilled").select("src", "dst")


@query(graph("SELECT DISTINCT array_to_string(labels, ':') AS labels FROM edges JOIN nodes ON node_id = src WHERE rel = 'LOCATED_IN'"))
def distinct_src_labels(spark, d):
    return pa.distinct_source_labels(edges(spark, d), nodes(spark, d), "LOCATED_IN").select(*names("labels", by=":"))


@query(graph("""SELECT a.dst AS nation, count(*) AS orders, count(DISTINCT b.dst) AS fulfilled FROM edges AS a JOIN edges AS b ON b.src = a.src AND b.rel = 'HAS_ORDER'
JOIN nodes AS o ON o.node_id = b.dst AND list_contains(o.labels, 'Fulfilled') JOIN nodes AS p ON p.node_id = a.src AND list_contains(p.labels, 'Debtor') WHERE a.rel = 'LIVES_IN' GROUP BY 1"""))
def optional_property_by_nation(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    debt = pa.with_label(n, "Debtor").select(F.col("node_id").alias("src"))
    done = pa.with_label(n, "Fulfilled").select(F.col("node_id").alias("order"))
    lives = pa.of_type(e, "LIVES_IN").select("src", F.col("dst").alias("nation")).join(debt, "src", "left_semi")
    has = pa.of_type(e, "HAS_ORDER").select("src", F.col("dst").alias("order")).join(done, "order", "left_semi")
    return lives.join(has, "src").groupBy("nation").agg(F.count("*").alias("orders"), F.count_distinct("order").alias("fulfilled"))


@query(graph("""SELECT a.src AS start, a.dst AS middle, b.dst AS end FROM edges AS a JOIN edges AS b ON b.src = a.dst AND b.rel = 'HAS_LINE'
JOIN nodes AS n ON n.node_id = a.src AND list_contains(n.labels, 'Debtor') WHERE a.rel = 'HAS_ORDER'"""))
def two_hop_path(spark, d):
    return pa.two_hops(edges(spark, d), nodes(spark, d), ("Debtor", "HAS_ORDER", "Order"), ("HAS_LINE", "Part"))


@query(graph("SELECT n.node_id, array_to_string(n.labels, ':') AS labels, count(e.eid) AS degree FROM nodes AS n LEFT JOIN edges AS e ON e.src = n.node_id AND e.rel = 'HAS_ORDER' WHERE list_contains(n.labels, 'Customer') GROUP BY 1, 2"))
def optional_expand(spark, d):
    return pa.optional_degree(nodes(spark, d), edges(spark, d), "Customer", "HAS_ORDER").select("node_id", *names("labels", by=":"), "degree")


@query(graph("SELECT page, count(*) AS n, min(node_id) AS first, max(node_id) AS last FROM (SELECT node_id, CAST(floor((row_number() OVER (ORDER BY substr(node_id, 1, 8), node_id) - 1) / 1000) AS BIGINT) AS page FROM nodes) GROUP BY 1"))
def node_pages(spark, d):
    return pa.pages(nodes(spark, d).select("node_id"), "node_id", 1000).groupBy("page").agg(F.count("*").alias("n"), F.min("node_id").alias("first"), F.max("node_id").alias("last"))


@query(graph("SELECT rel AS rel_type, array_to_string(sl, ':') AS src_labels, array_to_string(dl, ':') AS dst_labels, count(*) AS n FROM ends GROUP BY ALL", True))
def edge_scan_with_labels(spark, d):
    return pa.end_labels(edges(spark, d), nodes(spark, d)).groupBy("rel_type", *(joined(F.col(x), ":").alias(x) for x in ("src_labels", "dst_labels"))).agg(F.count("*").alias("n"))


@query(graph("SELECT array_to_string(labels, ':') AS labels, k AS key, CAST(sum(b) AS DOUBLE) AS n FROM (SELECT n.labels, x.k, CASE WHEN list_contains(n.keys, x.k) THEN 1 ELSE 0 END AS b FROM nkeys AS n, (VALUES ('name'), ('acctbal'), ('priority')) AS x(k)) GROUP BY 1, 2"))
def presence_bits(spark, d):
    keys = ["name", "acctbal", "priority"]
    rows = nodes(spark, d).select("labels", F.arrays_zip(F.array(*map(F.lit, keys)).alias("key"), pa.presence(F.col("props"), keys).alias("b")).alias("z"))
    return rows.select("labels", F.explode("z").alias("z")).groupBy(joined(F.col("labels"), ":").alias("labels"), F.col("z.key").alias("key")).agg(F.sum("z.b").alias("n"))


@query(graph("SELECT kind, count(*) AS n, count(a) AS with_a, count(b) AS with_b FROM (SELECT 'node' AS kind, node_id AS a, NULL AS b FROM nodes UNION ALL SELECT 'edge', NULL, rel FROM edges) GROUP BY 1"))
def aligned_union(spark, d):
    a = nodes(spark, d).select(F.lit("node").alias("kind"), F.col("node_id").alias("a"))
    b = edges(spark, d).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("b"))
    return pa.aligned_union(a, b).groupBy("kind").agg(F.count("*").alias("n"), F.count("a").alias("with_a"), F.count("b").alias("with_b"))


# --- similarity -------------------------------------------------------------
WJ = "(SELECT coalesce(sum(1 / sqrt(n)), 0) FROM freq WHERE kind = '{k}' AND list_contains({x}, name))"


def _wj(kind: str, a: str, b: str) -> str:
    part = lambda x: WJ.format(k=kind, x=x)
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {part(f'list_intersect({a}, {b})')} / {part(f'list_distinct(list_concat({a}, {b}))')} END)"


TID = "array_to_string(labels, ':') || '|' || array_to_string(keys, ',')"


@query(graph(f"""SELECT a.t AS a, b.t AS b, round((2 * {_wj("label", "a.labels", "b.labels")} + {_wj("prop", "a.keys", "b.keys")}) / 3, 6) AS similarity
FROM ks AS a JOIN ks AS b ON a.t < b.t AND (list_has_any(a.labels, b.labels) OR list_has_any(a.keys, b.keys))""", extra=SIGS + f", ks AS (SELECT DISTINCT labels, keys, {TID} AS t FROM nkeys)"))
def weighted_jaccard_types(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    frequency = ab.attribute_frequency(ab.structural_node_types(n, e), ab.structural_edge_types(e, n))
    return di.type_similarities(di.key_set_types(n), frequency, 2.0, 1.0).select("a", "b", r6("similarity").alias("similarity"))


TOP = """sg AS (SELECT md5(TID || array_to_string(inc, ' ') || '>' || array_to_string(out, ' ')) AS t, inc, out FROM st),
one AS (SELECT t, 'i' AS side, len(inc) AS n, unnest(inc) AS sig FROM sg UNION ALL SELECT t, 'o', len(out), unnest(out) FROM sg),
parts AS (SELECT *, split_part(sig, ':', 1) AS rel, list_filter(string_split(split_part(sig, ':', 2), ','), lambda x: x <> '') AS ks FROM one),
pr AS (SELECT a.t AS a, b.t AS b, a.side, a.sig AS sa, b.sig AS sb, a.n AS na, b.n AS nb,
  CASE WHEN len(a.ks) + len(b.ks) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * len(list_intersect(a.ks, b.ks)) / len(list_distinct(list_concat(a.ks, b.ks))) END AS s
  FROM parts AS a JOIN parts AS b ON a.side = b.side AND a.rel = b.rel AND a.t < b.t),
m1 AS (SELECT a, b, side, sum(s) / any_value(na) AS m FROM (SELECT a, b, side, sa, any_value(na) AS na, max(s) AS s FROM pr GROUP BY ALL) GROUP BY 1, 2, 3),
m2 AS (SELECT a, b, side, sum(s) / any_value(nb) AS m FROM (SELECT a, b, side, sb, any_value(nb) AS nb, max(s) AS s FROM pr GROUP BY ALL) GROUP BY 1, 2, 3)""".replace("TID", TID)


@query(graph("SELECT a, b, round(sum(least(m1.m, m2.m)) / 2, 6) AS similarity FROM m1 JOIN m2 USING (a, b, side) GROUP BY 1, 2", extra=SIGS + "," + TOP))
def node_topology_similarity(spark, d):
    t = ab.structural_node_types(nodes(spark, d), edges(spark, d))
    tid = F.md5(F.concat(joined(F.col("labels"), ":"), F.lit("|"), joined(F.col("keys")), joined(F.col("incoming"), " "), F.lit(">"), joined(F.col("outgoing"), " ")))
    return di.topology_similarities(t.select(tid.alias("type_id"), "incoming", "outgoing")).select("a", "b", r6("similarity").alias("similarity"))


EID = "rel || '|' || array_to_string(keys, ',') || '|' || array_to_string(sl, ':') || '|' || array_to_string(sk, ',') || '|' || array_to_string(dl, ':') || '|' || array_to_string(dk, ',')"


@query(graph(f"""SELECT a.t AS a, b.t AS b, round(({_wj("label", "a.sl", "b.sl")} + {_wj("prop", "a.sk", "b.sk")} + {_wj("label", "a.dl", "b.dl")} + {_wj("prop", "a.dk", "b.dk")}) / 4, 6) AS similarity
FROM es AS a JOIN es AS b ON a.rel = b.rel AND a.t < b.t""", extra=SIGS + f", es AS (SELECT *, {EID} AS t FROM se WHERE rel <> 'HAS_LINE')"))
def edge_topology_similarity(spark, d):
    """Without HAS_LINE, as its SQL has it; ``edge_topology_similarity_whole`` takes all edge types."""
    return _edge_topology(spark, d, F.col("rel_type") != "HAS_LINE")


def _edge_topology(spark, d, taken: Column):
    n, e = nodes(spark, d), edges(spark, d)
    t = ab.structural_edge_types(e, n)
    frequency = ab.attribute_frequency(ab.structural_node_types(n, e), t)
    tid = F.concat_ws("|", "rel_type", joined(F.col("keys")), joined(F.col("src_labels"), ":"), joined(F.col("src_keys")), joined(F.col("dst_labels"), ":"), joined(F.col("dst_keys")))
    return di.edge_topology_similarities(t.where(taken).withColumn("type_id", tid), frequency).select("a", "b", r6("similarity").alias("similarity"))


@query()
def edge_topology_similarity_whole(spark, d):
    return _edge_topology(spark, d, F.lit(True))


PAIRS = "SELECT a.labels AS x, b.labels AS y FROM nt AS a JOIN nt AS b ON array_to_string(a.labels, chr(1)) < array_to_string(b.labels, chr(1)) AND list_has_any(a.labels, b.labels)"


@query(graph(f"SELECT array_to_string(x, ':') AS labels_a, array_to_string(y, ':') AS labels_b, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM ({PAIRS})", True))
def jaccard_label_pairs(spark, d):
    p = di.label_pairs(ab.node_types(nodes(spark, d)))
    return p.select(*names("labels_a", "labels_b", by=":"), r6(jaccard(F.col("labels_a"), F.col("labels_b"))).alias("similarity"))


@query(graph("SELECT array_to_string(a.labels, ':') AS labels_a, array_to_string(b.labels, ':') AS labels_b, round(CASE WHEN len(a.mandatory) + len(b.mandatory) = 0 THEN 1 ELSE 2.0::DOUBLE * len(list_intersect(a.mandatory, b.mandatory)) / (len(a.mandatory) + len(b.mandatory)) END, 6) AS similarity FROM nt AS a JOIN nt AS b ON array_to_string(a.labels, ':') < array_to_string(b.labels, ':')", True))
def dice_pairs(spark, d):
    t = ab.node_types(nodes(spark, d)).select(joined(F.col("labels"), ":").alias("l"), "mandatory").cache()
    a, b = (t.select(F.col("l").alias(f"labels_{x}"), F.col("mandatory").alias(x)) for x in "ab")
    return a.join(b, F.col("labels_a") < F.col("labels_b")).select("labels_a", "labels_b", r6(dice(F.col("a"), F.col("b"))).alias("similarity"))


@query("""WITH w AS (SELECT p_name AS a, p_type AS b FROM part),
g AS (SELECT a, b, list_transform(range(1, len(a)), lambda i: substr(a, i, 2)) AS x, list_transform(range(1, len(b)), lambda i: substr(b, i, 2)) AS y FROM w)
SELECT a, b, round(CASE WHEN a = b THEN 1 WHEN len(a) < 2 OR len(b) < 2 THEN 0 ELSE 2.0::DOUBLE * list_sum(list_transform(list_distinct(x), lambda k: least(len(list_filter(x, lambda v: v = k)), len(list_filter(y, lambda v: v = k))))) / (len(x) + len(y)) END, 6) AS similarity FROM g""")
def bigram_dice_names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b"), r6(bigram_dice(F.col("p_name"), F.col("p_type"))).alias("similarity"))


# --- schema algebra ---------------------------------------------------------
@query(flattened("SELECT sid AS schema_id, child, anc AS ancestor FROM above WHERE v = ''"))
def extends_closure(spark, d):
    return fl.closure(schemas(spark, *c.ALL)).select("schema_id", "child", "ancestor")


@query(flattened("SELECT sid AS schema_id, tid AS type_id, array_to_string(labels, ':') AS labels, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM fn WHERE v = ''"))
def flatten_node_types(spark, d):
    return fl.flatten(schemas(spark, *c.ALL)).select("schema_id", F.explode("flat_nodes").alias("t")).select("schema_id", "t.type_id", joined(F.col("t.labels"), ":").alias("labels"), joined(F.col("t.mandatory")).alias("mandatory"), joined(F.col("t.optional")).alias("optional"))


@query(flattened("SELECT sid AS schema_id, rel AS rel_type, src AS src_type, dst AS dst_type, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional, card AS card_error FROM fe WHERE v = ''"))
def flatten_edge_types(spark, d):
    return fl.flatten(schemas(spark, *c.ALL)).select("schema_id", F.explode("flat_edges").alias("t")).select("schema_id", "t.rel_type", "t.src_type", "t.dst_type", joined(F.col("t.mandatory")).alias("mandatory"), joined(F.col("t.optional")).alias("optional"), "t.card_error")


def _types(spark, d):
    return ab.instance_types(nodes(spark, d), edges(spark, d))


def _flat(spark):
    return fl.flatten(schemas(spark, *c.ALL).withColumn("variant", F.lit("")))


@query(scored("SELECT sid AS schema_id, tid AS type_id, array_to_string(il, ':') AS labels, round(sim, 6) AS similarity FROM nsim WHERE v = ''"))
def node_similarity_matrix(spark, d):
    n, _ = _types(spark, d)
    n = n.cache()
    return sc.node_pairs(_flat(spark), n, Weights()).join(n.select("i_id", "labels"), "i_id").select("schema_id", "type_id", *names("labels", by=":"), r6("similarity").alias("similarity"))


@query(scored("SELECT sid AS schema_id, rel AS rel_type, array_to_string(sl, ':') AS src_labels, array_to_string(dl, ':') AS dst_labels, count(*) AS n, round(max(sim), 6) AS best FROM esim WHERE v = '' GROUP BY ALL"))
def edge_similarity_matrix(spark, d):
    n, e = _types(spark, d)
    e = e.cache()
    p = sc.edge_pairs(_flat(spark), e, Weights()).groupBy("schema_id", "i_id").agg(F.count("*").alias("n"), r6(F.max("similarity")).alias("best"))
    return p.join(e.select("i_id", "rel_type", joined(F.col("src.labels"), ":").alias("src_labels"), joined(F.col("dst.labels"), ":").alias("dst_labels")), "i_id").drop("i_id")


@query(scored("SELECT sid AS schema_id, round(nc, 6) AS coverage FROM cov WHERE v = ''"))
def node_coverage(spark, d):
    return sc.coverages(_flat(spark), *_types(spark, d), Weights()).select("schema_id", r6("node_cov").alias("coverage"))


@query(scored("SELECT sid AS schema_id, round(ec, 6) AS coverage FROM cov WHERE v = ''"))
def edge_coverage(spark, d):
    return sc.coverages(_flat(spark), *_types(spark, d), Weights()).select("schema_id", r6("edge_cov").alias("coverage"))


PLAIN = (c.FLAT, c.NO_SUPPLIER, c.NO_NAMES, c.TWIN, c.EXTRA, c.REVERSED, c.FLAGGED)


@query(scored("SELECT sid AS schema_id, round(econ, 6) AS edge_concision FROM con", PLAIN, True))
def edge_concision_top2(spark, d):
    return sc.edge_concision_top2(schemas(spark, *PLAIN), *_types(spark, d)).select("schema_id", r6("edge_concision").alias("edge_concision"))


@query(scored("SELECT sid AS schema_id, v AS variant, round(nc, 6) AS node_cov, round(ec, 6) AS edge_cov FROM cov WHERE v LIKE 'n:%'"))
def node_concision_variants(spark, d):
    cov = sc.coverages(fl.flatten(fl.variants(schemas(spark, *c.ALL))), *_types(spark, d), Weights())
    return cov.where("variant like 'n:%'").select("schema_id", "variant", r6("node_cov").alias("node_cov"), r6("edge_cov").alias("edge_cov"))


@query(scored("SELECT sid AS schema_id, v AS variant, round(nc, 6) AS node_cov, round(ec, 6) AS edge_cov FROM cov WHERE v LIKE 'e:%'", (c.EXTENDING, c.BACKWARD, c.LOOPED)))
def edge_concision_extends(spark, d):
    cov = sc.coverages(fl.flatten(fl.variants(schemas(spark, c.EXTENDING, c.BACKWARD, c.LOOPED))), *_types(spark, d), Weights())
    return cov.where("variant like 'e:%'").select("schema_id", "variant", r6("node_cov").alias("node_cov"), r6("edge_cov").alias("edge_cov"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("schema_id", *(r6(x).alias(x) for x in rows.columns if x != "schema_id"))




@query(scored(SCORE, c.ALL, True))
def c2_score(spark, d):
    return _rounded(sc.score(schemas(spark, *c.ALL), *_types(spark, d)))


@query(scored(SCORE, (c.FLAT, c.FLAGGED, c.EXTENDING), True, endpoint="(1.0::DOUBLE / 3)", cardinality="(1.0::DOUBLE / 3)"))
def c2_cardinality_mode(spark, d):
    return _rounded(sc.score(schemas(spark, c.FLAT, c.FLAGGED, c.EXTENDING), *_types(spark, d), Weights.with_cardinality()))




def _f1_sql() -> str:
    union = lambda m, o: f"list_sort(list_distinct(list_concat({m}, {o})))"
    keys = f"""
nk AS (SELECT DISTINCT sid, (labels, {union("mandatory", "optional")})::VARCHAR AS k FROM fn WHERE v = ''),
ek AS (SELECT DISTINCT sid, (rel, {union("mandatory", "optional")}, s_l, {union("s_m", "s_o")}, d_l, {union("d_m", "d_o")})::VARCHAR AS k FROM fe WHERE v = ''),
ids AS (SELECT DISTINCT sid FROM star_n WHERE sid <> 'extending')"""
    body = flattened("SELECT 1")
    head = body[: body.rindex("\nSELECT 1")]
    part = lambda t, name: f"""(SELECT sid, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS {name}_p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS {name}_r FROM (
  SELECT ids.sid, (SELECT count(*) FROM {t} AS p WHERE p.sid = ids.sid AND p.k IN (SELECT k FROM {t} WHERE sid = 'extending')) AS tp,
  (SELECT count(*) FROM {t} AS p WHERE p.sid = ids.sid AND p.k NOT IN (SELECT k FROM {t} WHERE sid = 'extending')) AS fp,
  (SELECT count(*) FROM {t} AS g WHERE g.sid = 'extending' AND g.k NOT IN (SELECT k FROM {t} WHERE sid = ids.sid)) AS fn FROM ids))"""  # noqa: E731
    f1 = lambda n: f"round(CASE WHEN {n}_p + {n}_r > 0 THEN 2 * {n}_p * {n}_r / ({n}_p + {n}_r) ELSE 0 END, 6) AS {n}_f1"
    cols = ", ".join(f"round({n}_p, 6) AS {n}_precision, round({n}_r, 6) AS {n}_recall, {f1(n)}" for n in ("node", "edge"))
    return f"{head},{keys}\nSELECT a.sid AS schema_id, {cols} FROM {part('nk', 'node')} AS a JOIN {part('ek', 'edge')} AS b ON a.sid = b.sid"


@query(_f1_sql())
def schema_f1(spark, d):
    given = [s for s in c.ALL if s is not c.EXTENDING]
    return _rounded(sc.schema_f1(schemas(spark, *given).withColumn("truth_id", F.lit("extending")), schemas(spark, c.EXTENDING)))


@query(flattened("SELECT sid AS schema_id, tid AS type_id, prop FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY tid, prop) AS r, count(*) OVER (PARTITION BY sid) AS n FROM (SELECT sid, tid, unnest(list_concat(mandatory, optional)) AS prop FROM star_n)) WHERE r <= least(n, greatest(1, floor((n * 3 + 5) / 10)))"))
def inject_missing_property_ratio(spark, d):
    return ij.remove_first_properties(schemas(spark, *c.ALL), 3)


@query(flattened("SELECT n.sid AS schema_id, CAST(n.p AS INTEGER) AS node_props, CAST(e.p AS INTEGER) AS edge_props FROM (SELECT sid, sum(len(mandatory) + len(optional)) AS p FROM star_n GROUP BY 1) AS n JOIN (SELECT sid, sum(len(mandatory) + len(optional)) AS p FROM star_e GROUP BY 1) AS e ON n.sid = e.sid"))
def schema_property_totals(spark, d):
    return ij.property_totals(schemas(spark, *c.ALL))


@query()
def inject_sweep_summary(spark, d):
    """Three levels and three trials, without cardinalities; ``inject_sweep_whole`` takes all."""
    return ij.sweep(schemas(spark, c.EXTENDING), *_types(spark, d), levels=(1, 3, 5), n=3)


@query()
def inject_sweep_whole(spark, d):
    return ij.sweep(schemas(spark, c.EXTENDING), *_types(spark, d), Weights.with_cardinality(), cardinality=True)


@query(flattened("SELECT 'flat' AS schema_id, tid AS type_id, array_to_string(labels, ':') AS labels, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM star_n", (c.FLAT,)))
def schema_graph_reader(spark, d):
    n, e = schema_to_graph(schemas(spark, c.FLAT))
    row = schema_from_graph(n.drop("schema_id"), e.drop("schema_id"), "flat")
    return row.select("schema_id", F.explode("nodes").alias("t")).select("schema_id", "t.type_id", joined(F.col("t.labels"), ":").alias("labels"), joined(F.col("t.mandatory")).alias("mandatory"), joined(F.col("t.optional")).alias("optional"))


# --- discovery --------------------------------------------------------------
UPS = f"""pr2 AS ({PAIRS}), sh AS (SELECT x, y, list_sort(list_intersect(x, y)) AS s FROM pr2),
sup AS (
  SELECT y AS child, x AS parent, false AS made FROM sh WHERE len(s) = len(x) AND len(x) < len(y)
  UNION SELECT x, y, false FROM sh WHERE len(s) = len(y) AND len(y) < len(x)
  UNION SELECT unnest([x, y]), s, s NOT IN (SELECT labels FROM nt) FROM sh WHERE len(s) < len(x) AND len(s) < len(y))"""


@query(graph("SELECT array_to_string(child, ':') AS child, array_to_string(parent, ':') AS parent, made FROM sup", True, UPS))
def supertype_pairs(spark, d):
    return di.supertypes(ab.node_types(nodes(spark, d))).select(*names("child", "parent", by=":"), "made")


@query(graph("SELECT DISTINCT array_to_string(parent, ':') AS labels FROM sup WHERE made", True, UPS))
def supertype_new_parents(spark, d):
    return di.supertypes(ab.node_types(nodes(spark, d))).where("made").select(joined(F.col("parent"), ":").alias("labels")).distinct()


@query(graph("""SELECT array_to_string(labels, ':') AS labels, array_to_string(list_sort(list_filter(labels, lambda l: NOT list_contains(ul, l))), ':') AS own_labels, array_to_string(list_sort(list_filter(ps, lambda p: NOT list_contains(up, p))), ',') AS own_props FROM (
SELECT t.labels, list_distinct(list_concat(t.mandatory, t.optional)) AS ps, coalesce((SELECT flatten(list(parent)) FROM sup WHERE child = t.labels), []) AS ul,
coalesce((SELECT flatten(list(list_concat(p.mandatory, p.optional))) FROM sup JOIN nt AS p ON p.labels = sup.parent WHERE sup.child = t.labels), []) AS up FROM nt AS t)""", True, UPS))
def strip_inherited(spark, d):
    t = ab.node_types(nodes(spark, d)).cache()
    return di.strip_inherited(t, di.supertypes(t)).select(*names("labels", by=":"), joined(F.col("own_labels"), ":").alias("own_labels"), joined(F.col("own_props")).alias("own_props"))


@query()
def label_set_schema(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return di.label_set_schema(ab.node_types(n), ab.edge_types(e, n)).select("schema_id", F.explode("edges").alias("t")).select("schema_id", "t.edge_id", "t.rel_type", joined(F.col("t.mandatory")).alias("mandatory"), joined(F.col("t.optional")).alias("optional"))


@query()
def weighted_jaccard_partition(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    t = di.key_set_types(n).cache()
    frequency = ab.attribute_frequency(ab.structural_node_types(n, e), ab.structural_edge_types(e, n))
    parts = di.greedy_partition(t, di.type_similarities(t, frequency), 0.5)
    return di.partition_types(t, parts).select("part", *names("labels", by=":"), *names("mandatory", "optional"))


def _edge_partition(spark, d):
    """Node partitions and edge types of edge partitions: edge types have their type as label, weighted as node types are."""
    n, e = nodes(spark, d), edges(spark, d)
    frequency = ab.attribute_frequency(ab.structural_node_types(n, e), ab.structural_edge_types(e, n)).cache()
    t, et = di.key_set_types(n).cache(), di.edge_key_set_types(e, n).cache()
    made = di.partition_types(t, di.greedy_partition(t, di.type_similarities(t, frequency), 0.5))
    return made, di.partition_edge_types(et, di.greedy_partition(et, di.type_similarities(et, frequency), 0.5))


def _edge_rows(found: DataFrame) -> DataFrame:
    return found.select("rel_type", *names("src_labels", "dst_labels", by=":"), *names("mandatory", "optional"))


#: Edge types share their one label or nothing, so that partitions are the types' names.
EDGE_PARTS = """pt AS (SELECT DISTINCT sl, ekeys.rel, dl, keys FROM ekeys JOIN ends USING (eid)), tn AS (SELECT rel, count(*) AS n FROM pt GROUP BY 1),
tk AS (SELECT rel, k, count(*) AS c FROM (SELECT rel, unnest(keys) AS k FROM pt) GROUP BY 1, 2),
ts AS (SELECT tn.rel, coalesce(string_agg(k, ',' ORDER BY k) FILTER (c = n), '') AS mandatory, coalesce(string_agg(k, ',' ORDER BY k) FILTER (c < n), '') AS optional FROM tn LEFT JOIN tk ON tk.rel = tn.rel GROUP BY 1)"""


@query(graph("SELECT DISTINCT pt.rel AS rel_type, array_to_string(sl, ':') AS src_labels, array_to_string(dl, ':') AS dst_labels, mandatory, optional FROM pt JOIN ts ON ts.rel = pt.rel", True, EDGE_PARTS))
def weighted_jaccard_edge_partition(spark, d):
    return _edge_rows(_edge_partition(spark, d)[1])


@query()
def weighted_jaccard_attached_edges(spark, d):
    made, found = _edge_partition(spark, d)
    return _edge_rows(di.attach_edges(found, made))


@query(graph("SELECT DISTINCT a.t AS src, rel AS rel_type, b.t AS dst FROM se JOIN kn AS a ON a.labels = sl AND a.keys = sk JOIN kn AS b ON b.labels = dl AND b.keys = dk", extra=SIGS + f", kt AS (SELECT DISTINCT labels, keys FROM nkeys), kn AS (SELECT *, {TID} AS t FROM kt)"))
def edges_by_helper_strings(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    types = di.key_set_types(n).select(F.col("type_id").alias("id"), *names("labels", by=":"), joined(F.col("keys")).alias("properties")).cache()
    ends = (c for p in ("src", "dst") for c in (joined(F.col(f"{p}_labels"), ":").alias(f"{p}_labels"), joined(F.col(f"{p}_keys")).alias(f"{p}_properties")))
    return di.edges_by_strings(ab.structural_edge_types(e, n).select("rel_type", *ends), types)


def _patterns(spark, d):
    return ab.node_patterns(nodes(spark, d))


def _clusters(rows: DataFrame) -> DataFrame:
    return rows.select("cluster_id", *names("labels", by=":"), *names("keys"), "n")


@query()
def lsh_node_clusters(spark, d):
    return _clusters(cl.cluster_nodes(_patterns(spark, d), "LSH"))


@query()
def minhash_node_clusters(spark, d):
    return _clusters(cl.cluster_nodes(_patterns(spark, d), "MINHASH"))


@query()
def kmeans_node_clusters(spark, d):
    return _clusters(cl.cluster_nodes(_patterns(spark, d), "KMEANS"))


@query()
def lsh_edge_clusters(spark, d):
    e = cl.edge_clusters(ab.edge_patterns(edges(spark, d), nodes(spark, d)))
    return cl.merge_edge_clusters(e, by_ends=False).select("rel_type", "members", *names("mandatory", "optional"), *names("src_sets", "dst_sets", by=" "))


@query(graph("SELECT array_to_string(sl, ':') AS src_labels, rel AS rel_type, array_to_string(dl, ':') AS dst_labels, n AS members, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM et", True))
def minhash_edge_clusters(spark, d):
    e = cl.edge_clusters(ab.edge_patterns(edges(spark, d), nodes(spark, d)), "MINHASH")
    return cl.merge_edge_clusters(e).select(*names("src_labels", "dst_labels", by=":"), "rel_type", "members", *names("mandatory", "optional"))


@query(graph("""SELECT rn.rel AS rel_type, members, mandatory, optional, src_sets, dst_sets FROM rn JOIN rs ON rs.rel = rn.rel""", True, """rn AS (SELECT rel, count(*) AS members, string_agg(DISTINCT array_to_string(sl, ':'), ' ' ORDER BY array_to_string(sl, ':')) AS src_sets, string_agg(DISTINCT array_to_string(dl, ':'), ' ' ORDER BY array_to_string(dl, ':')) AS dst_sets FROM ends GROUP BY 1),
rk AS (SELECT rel, k, count(*) AS c FROM edges JOIN ep USING (eid) GROUP BY 1, 2),
rs AS (SELECT rn.rel, coalesce(string_agg(k, ',' ORDER BY k) FILTER (c = members), '') AS mandatory, coalesce(string_agg(k, ',' ORDER BY k) FILTER (c < members), '') AS optional FROM rn LEFT JOIN rk ON rk.rel = rn.rel GROUP BY 1)"""))
def kmeans_edge_clusters(spark, d):
    e = cl.edge_clusters(ab.edge_patterns(edges(spark, d), nodes(spark, d)), "KMEANS")
    return cl.merge_edge_clusters(e, by_ends=False).select("rel_type", "members", *names("mandatory", "optional"), *names("src_sets", "dst_sets", by=" "))


@query()
def gmm_split(spark, d):
    return cl.mixture_tree(cl.sampled(_patterns(spark, d))).select("path", *names("labels", by=":"), *names("keys"), "n")


@query()
def gmm_type_table(spark, d):
    return cl.type_table(cl.mixture_tree(cl.sampled(_patterns(spark, d))))


@query()
def gmm_split_whole(spark, d):
    return cl.mixture_forest(cl.sampled(_patterns(spark, d))).select("base", "path", *names("labels", by=":"), *names("keys"), "n")


@query()
def gmm_type_table_whole(spark, d):
    return cl.type_table(cl.mixture_forest(cl.sampled(_patterns(spark, d))))


@query(graph("SELECT array_to_string(labels, ':') AS labels, n AS members, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM nt", True))
def merge_by_labels(spark, d):
    return di.merge_by_labels(cl.cluster_nodes(_patterns(spark, d), "LSH")).select(*names("labels", by=":"), "members", *names("mandatory", "optional"))


BARE = f"kt AS (SELECT DISTINCT CASE WHEN list_contains(labels, 'Debtor') OR list_contains(labels, 'Click') THEN CAST([] AS VARCHAR[]) ELSE labels END AS labels, keys FROM nkeys), kn AS (SELECT *, {TID} AS t FROM kt)"


@query(graph("""SELECT t AS type_id, m AS match, round(s, 6) AS similarity FROM (SELECT a.t, b.t AS m, len(list_intersect(a.keys, b.keys))::DOUBLE / len(list_distinct(list_concat(a.keys, b.keys))) AS s, row_number() OVER (PARTITION BY a.t ORDER BY len(list_intersect(a.keys, b.keys))::DOUBLE / len(list_distinct(list_concat(a.keys, b.keys))) DESC, b.t) AS r
FROM kn AS a JOIN kn AS b ON len(a.labels) = 0 AND len(b.labels) > 0 AND list_has_any(a.keys, b.keys)) WHERE r = 1 AND s >= 0.6""", extra=BARE))
def unlabelled_match(spark, d):
    hide = F.when(F.arrays_overlap("labels", F.array(F.lit("Debtor"), F.lit("Click"))), F.array().cast("array<string>")).otherwise(F.col("labels"))
    t = di.key_set_types(nodes(spark, d).withColumn("labels", hide)).cache()
    return di.match_unlabelled(t, 0.6).select("type_id", "match", r6("similarity").alias("similarity"))


# --- types, cardinalities, evaluation ---------------------------------------
@query(graph("""SELECT rel AS rel_type, max(o) AS max_out, max(i) AS max_in, CASE WHEN max(i) > 1 THEN 'N' ELSE '1' END || ':' || CASE WHEN max(o) > 1 THEN 'N' ELSE '1' END AS cardinality
FROM (SELECT rel, count(DISTINCT dst) AS o, NULL AS i FROM edges GROUP BY rel, src UNION ALL SELECT rel, NULL, count(DISTINCT src) FROM edges GROUP BY rel, dst) GROUP BY 1"""))
def rel_cardinality(spark, d):
    return inf.cardinalities(edges(spark, d)).select("rel_type", "max_out", "max_in", "cardinality")


@query(graph("""SELECT array_to_string(sl, ':') AS src_labels, rel AS rel_type, array_to_string(dl, ':') AS dst_labels, max(o) AS max_out, min(o) AS min_out, round(avg(o), 6) AS avg_out, max(i) AS max_in, min(i) AS min_in, round(avg(i), 6) AS avg_in
FROM (SELECT sl, ends.rel, dl, count(DISTINCT dst) AS o, NULL AS i FROM ends JOIN edges USING (eid) GROUP BY sl, ends.rel, dl, src UNION ALL SELECT sl, ends.rel, dl, NULL, count(DISTINCT src) FROM ends JOIN edges USING (eid) GROUP BY sl, ends.rel, dl, dst) GROUP BY 1, 2, 3""", True))
def degree_stats(spark, d):
    got = inf.cardinalities(edges(spark, d), nodes(spark, d))
    return got.select(*names("src_labels", "dst_labels", by=":"), "rel_type", "max_out", "min_out", r6("avg_out").alias("avg_out"), "max_in", "min_in", r6("avg_in").alias("avg_in"))


IP = "regexp_matches(trim(v), '^((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$')"
TESTS = {"i": "regexp_matches(trim(v), '^[+-]?[0-9]+$') AND TRY_CAST(trim(v) AS INTEGER) IS NOT NULL", "d": "TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL", "t": "regexp_matches(trim(v), '^-?[0-9]')", "b": "lower(trim(v)) IN ('true', 'false', 'yes', 'no', '1', '0')"}


@query(graph(f"""SELECT array_to_string(labels, ':') AS labels, k AS prop, count(*) AS n, CASE WHEN bool_and({IP}) THEN 'String' WHEN bool_and({TESTS["i"]}) THEN 'Integer' WHEN bool_and({TESTS["d"]}) THEN 'Double' WHEN bool_and({TESTS["t"]}) THEN 'Date' WHEN bool_and({TESTS["b"]}) THEN 'Boolean' ELSE 'String' END AS type
FROM nodes JOIN np USING (node_id) GROUP BY 1, 2"""))
def infer_types_cascade(spark, d):
    return inf.infer_types(nodes(spark, d), ["labels"]).select(*names("labels", by=":"), "prop", "n", "type")


@query(graph(f"""SELECT array_to_string(labels, ':') AS labels, k AS prop, CAST(total AS BIGINT) AS n, kind AS majority, round(n::DOUBLE / total, 6) AS support, CAST(least(5, floor(n::DOUBLE / total * 5) + 1) AS INTEGER) AS bin FROM (
SELECT *, sum(n) OVER (PARTITION BY labels, k) AS total, row_number() OVER (PARTITION BY labels, k ORDER BY n DESC, kind) AS r FROM (
SELECT labels, k, CASE WHEN {IP} THEN 'String' WHEN {TESTS["i"]} THEN 'Integer' WHEN {TESTS["d"]} THEN 'Double' WHEN {TESTS["t"]} THEN 'Date' WHEN {TESTS["b"]} THEN 'Boolean' ELSE 'String' END AS kind, count(*) AS n FROM nodes JOIN np USING (node_id) GROUP BY 1, 2, 3)) WHERE r = 1"""))
def infer_types_support(spark, d):
    return inf.type_support(nodes(spark, d), ["labels"]).select(*names("labels", by=":"), "prop", "n", "majority", r6("support").alias("support"), "bin")


@query()
def infer_types_sampled(spark, d):
    return inf.infer_types(nodes(spark, d), ["labels"], sample=1000).select(*names("labels", by=":"), "prop", "n", "type")


@query()
def type_sample_agreement(spark, d):
    got = inf.support_agreement(nodes(spark, d), ["labels"])
    return got.select(*names("labels", by=":"), "prop", "agrees", r6("delta").alias("delta"))


MAJ = """mem AS (SELECT {cluster} AS cid, {label} AS l, count(*) AS n FROM {src} GROUP BY 1, 2),
maj AS (SELECT cid, l AS m FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, l) AS r FROM mem) WHERE r = 1),
jd AS (SELECT mem.*, m FROM mem JOIN maj USING (cid)),
cnt AS (SELECT CAST(sum(n) FILTER (l = m) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (l <> m), 0) AS BIGINT) AS fp,
  (SELECT CAST(sum(greatest(0, a.n - coalesce(p.n, 0))) AS BIGINT) FROM (SELECT l, sum(n) AS n FROM jd GROUP BY 1) AS a LEFT JOIN (SELECT m, sum(n) AS n FROM jd GROUP BY 1) AS p ON p.m = a.l) AS fn FROM jd)"""
PRF = "SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS majority_precision, round(tp::DOUBLE / (tp + fn), 6) AS majority_recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 6) AS majority_f1 FROM cnt"


def _prf(rows: DataFrame) -> DataFrame:
    return ev.majority_scores(rows).select("tp", "fp", "fn", *(r6(f"majority_{x}").alias(f"majority_{x}") for x in ("precision", "recall", "f1")))


@query(graph(PRF, extra=MAJ.format(cluster="array_to_string(keys, ',')", label="array_to_string(labels, ':')", src="nkeys")))
def majority_label_eval(spark, d):
    rows = nodes(spark, d).groupBy(joined(present(F.col("props"))).alias("cluster_id"), joined(F.col("labels"), ":").alias("label")).agg(F.count("*").alias("n"))
    return _prf(rows)


@query(graph(PRF, True, MAJ.format(cluster="array_to_string(sl, ':') || '>' || array_to_string(dl, ':')", label="rel", src="(SELECT CASE WHEN list_contains(dl, 'Order') THEN ['Order'] ELSE dl END AS dl, CASE WHEN list_contains(sl, 'Customer') THEN ['Customer'] ELSE ['Thing'] END AS sl, rel FROM ends)")))
def edge_majority_eval(spark, d):
    e = pa.end_labels(edges(spark, d).select("src", "dst", "rel_type"), nodes(spark, d))
    src = F.when(F.array_contains("src_labels", "Customer"), F.lit("Customer")).otherwise(F.lit("Thing"))
    dst = F.when(F.array_contains("dst_labels", "Order"), F.lit("Order")).otherwise(joined(F.col("dst_labels"), ":"))
    return _prf(e.groupBy(F.concat_ws(">", src, dst).alias("cluster_id"), F.col("rel_type").alias("label")).agg(F.count("*").alias("n")))


# --- rankings: four items ranked by every customer, from digits of its key ----
PERMUTED = "list_transform([0, 1, 2, 3], lambda i: (i * CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 1 END + c_custkey // 7) % 4 + 1)"
RANKS = f"""rk AS (SELECT c_custkey AS rater, 'Q' || (c_nationkey % 5) || '-1' AS question, unnest(['A', 'B', 'C', 'D']) AS item,
unnest(CASE WHEN c_custkey % 11 = 0 THEN [1, 2, NULL, 4] WHEN c_custkey % 13 = 0 THEN [1, 1, 2, 4] ELSE {PERMUTED} END) AS rank FROM customer),
full_rk AS (SELECT * FROM rk WHERE rater NOT IN (SELECT rater FROM rk WHERE rank IS NULL)),
perm AS (SELECT * FROM full_rk WHERE rater IN (SELECT rater FROM full_rk GROUP BY rater HAVING list_sort(list(rank)) = [1, 2, 3, 4])),
bo AS (SELECT question, item, CAST(sum(4 - rank) AS BIGINT) AS points FROM perm GROUP BY 1, 2),
go AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY points DESC, item) AS INTEGER) AS rank FROM bo)"""


def ranks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    turned = F.transform(F.array(*map(F.lit, range(4))), lambda i: ((i * F.when(k % 3 == 0, 3).otherwise(1) + F.floor(k / 7)) % 4 + 1).cast("int"))
    fixed = lambda *v: F.array(*(F.lit(x).cast("int") for x in v))
    four = F.when(k % 11 == 0, fixed(1, 2, None, 4)).when(k % 13 == 0, fixed(1, 1, 2, 4)).otherwise(turned)
    rows = table(spark, d, "customer").select(k.alias("rater"), F.concat(F.lit("Q"), (F.col("c_nationkey") % 5).cast("string"), F.lit("-1")).alias("question"), F.posexplode(four).alias("i", "rank"))
    return rows.select("rater", "question", F.element_at(F.array(*map(F.lit, "ABCD")), F.col("i") + 1).alias("item"), "rank")


@query(f"WITH {RANKS} SELECT * FROM go")
def borda_golden(spark, d):
    return rs.golden(ranks(spark, d))


W = """ww AS (SELECT s.question, m, n, 12.0::DOUBLE * (rr - r * r::DOUBLE / n) / (m * m * (n * n * n - n) - m * t) AS w FROM
(SELECT question, count(*) AS n, sum(r * r) AS rr, sum(r) AS r FROM (SELECT question, item, CAST(sum(rank) AS BIGINT) AS r FROM full_rk GROUP BY 1, 2) GROUP BY 1) AS s
JOIN (SELECT question, count(DISTINCT rater) AS m FROM full_rk GROUP BY 1) AS u USING (question)
JOIN (SELECT question, sum(c * c * c - c) AS t FROM (SELECT question, rater, rank, count(*) AS c FROM full_rk GROUP BY 1, 2, 3) GROUP BY 1) AS v USING (question))"""


@query(f"WITH {RANKS}, {W} SELECT question, m AS raters, n AS items, round(w, 6) AS w FROM ww")
def kendall_w(spark, d):
    return rs.kendall_w(ranks(spark, d)).select("question", "raters", "items", r6("w").alias("w"))


@query(f"WITH {RANKS}, {W} SELECT question, round(w, 6) AS w, round(m * (n - 1) * w, 6) AS chi2, n - 1 AS df FROM ww")
def kendall_w_chi2(spark, d):
    return rs.kendall_w_test(ranks(spark, d)).select("question", r6("w").alias("w"), r6("chi2").alias("chi2"), "df")


@query(f"""WITH {RANKS}, x AS (SELECT f.rater, f.question, f.item, f.rank, go.rank AS g FROM full_rk AS f JOIN go ON go.question = f.question AND go.item = f.item),
p AS (SELECT a.rater, a.question, sum(sign(a.rank - b.rank) * sign(a.g - b.g)) AS c, sum(abs(sign(a.rank - b.rank))) AS s, sum(abs(sign(a.g - b.g))) AS t FROM x AS a JOIN x AS b ON a.rater = b.rater AND a.item < b.item GROUP BY 1, 2)
SELECT rater, question, round(c / sqrt(s::DOUBLE * t), 6) AS tau FROM p""")
def kendall_tau(spark, d):
    r = ranks(spark, d).cache()
    return rs.kendall_tau(r, rs.golden(r)).select("rater", "question", r6("tau").alias("tau"))


# --- export, increments -----------------------------------------------------
def typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge types with property types and cardinalities, as the exporters take them."""
    n, e = nodes(spark, d), edges(spark, d)
    of = lambda df, key: df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("prop", "type"))).alias("types"))
    none = F.create_map().cast("map<string,string>")
    node_rows = ab.node_types(n).join(of(inf.infer_types(n, ["labels"]), ["labels"]), "labels", "left").withColumn("types", F.coalesce("types", none))
    edge_rows = ab.edge_types(e, n).join(of(inf.infer_types(e, ["rel_type"]), ["rel_type"]), "rel_type", "left").withColumn("types", F.coalesce("types", none))
    return node_rows, edge_rows.join(inf.cardinalities(e).select("rel_type", "cardinality"), "rel_type")


@query()
def strict_ddl(spark, d):
    return ddl.strict_ddl(*typed(spark, d))


@query()
def loose_ddl(spark, d):
    return ddl.loose_ddl(*typed(spark, d))


@query()
def xsd_types(spark, d):
    return ddl.xsd_elements(*typed(spark, d))


@query(graph("SELECT DISTINCT array_to_string(labels, ':') AS labels, array_to_string(list_sort(mandatory), ',') AS mandatory, array_to_string(list_sort(optional), ',') AS optional FROM (SELECT unnest([[l] FOR l IN labels]) AS labels, mandatory, optional FROM nt WHERE len(labels) = 1)", True))
def strict_ddl_round_trip(spark, d):
    """Types of one label, as its SQL has it; ``strict_ddl_round_trip_whole`` takes all node types."""
    return _round_trip(spark, d, F.size("labels") == 1)


def _round_trip(spark, d, taken: Column):
    n, e = typed(spark, d)
    text = ddl.strict_ddl(n.where(taken), e).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text")).cache()  # one row, read three times
    row = ddl.read_schemas(text.select(F.lit("s").alias("schema_id"), "text"))
    return row.select(F.explode("nodes").alias("t")).select(joined(F.col("t.labels"), ":").alias("labels"), joined(F.col("t.mandatory")).alias("mandatory"), joined(F.col("t.optional")).alias("optional"))


@query()
def strict_ddl_round_trip_whole(spark, d):
    return _round_trip(spark, d, F.lit(True))


@query(graph("SELECT array_to_string(labels, ':') AS labels, n, array_to_string(mandatory, ',') AS mandatory, array_to_string(optional, ',') AS optional FROM nt", True))
def incremental_abstraction(spark, d):
    paged = nodes(spark, d).withColumn("page", F.pmod(F.xxhash64("node_id"), F.lit(7)))
    return inc.by_page(paged).select(*names("labels", by=":"), "n", *names("mandatory", "optional"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, key, count(*) AS n FROM (SELECT ts, event_type, unnest(list_concat([''], json_keys(props))) AS key FROM events) GROUP BY 1, 2, 3""")
def event_schema_drift(spark, d):
    return inc.drift(table(spark, d, "events"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def ad_hoc_query(spark, d):
    from ..sources.graph import query as ask

    return ask(spark, "SELECT props['mktsegment'] AS segment, count(*) AS n FROM {nodes} WHERE array_contains(labels, :label) GROUP BY 1", nodes(spark, d), edges(spark, d), label="Customer")


# --- generic operators on vectors -------------------------------------------
@query("""SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(list_zip(embedding, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))), 4) AS spread FROM embeddings JOIN
(SELECT label, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda v: CAST(v[i] AS DOUBLE)))) AS m FROM (SELECT label, list(embedding) AS vs FROM embeddings GROUP BY 1)) USING (label) GROUP BY 1""")
def vector_spread(spark, d):
    from ..functions.similarity import euclidean

    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    return rows.join(means, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(euclidean(F.col("v"), F.col("m"))), 4).alias("spread"))


