"""DuckDB forms of the graph queries, written from the definitions."""

from __future__ import annotations

from ..model import Schema
from .candidates import ALL

GRAPH = """
line AS MATERIALIZED (SELECT *, row_number() OVER () AS rn FROM lineitem),
nodes AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS node_id, ['Region'] AS labels FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, ['Nation'] FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN c_acctbal < 0 THEN ['Customer', 'Debtor'] ELSE ['Customer'] END FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, ['Supplier'] FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, ['Part'] FROM part
  UNION ALL SELECT 'order:' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ['Fulfilled', 'Order'] ELSE ['Order'] END FROM orders
  UNION ALL SELECT 'event:' || event_id, list_sort(['Event', upper(event_type[1]) || event_type[2:]]) FROM events),
np AS MATERIALIZED (
  SELECT * FROM (
  SELECT 'region:' || r_regionkey AS node_id, 'name' AS k, r_name AS v FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'name', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, unnest(['name', 'mktsegment', 'acctbal']), unnest([c_name, c_mktsegment, CASE WHEN c_acctbal < 0 OR c_acctbal >= 1000 THEN CAST(c_acctbal AS VARCHAR) END]) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, unnest(['name', 'acctbal']), unnest([s_name, CAST(s_acctbal AS VARCHAR)]) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, unnest(['name', 'brand', 'type', 'size', 'retailprice']), unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) FROM part
  UNION ALL SELECT 'order:' || o_orderkey, unnest(['totalprice', 'orderdate', 'orderstatus', 'priority']), unnest([CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderstatus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END]) FROM orders
  UNION ALL SELECT 'event:' || event_id, unnest(['ts', 'value', 'k']), unnest([CAST(ts AS VARCHAR), CAST(value AS VARCHAR), json_extract_string(props, '$.k')]) FROM events
  ) WHERE v IS NOT NULL),
edges AS MATERIALIZED (
  SELECT 'n' || n_nationkey AS eid, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'LOCATED_IN' AS rel FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LIVES_IN' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'customer:' || o_custkey, 'order:' || o_orderkey, 'HAS_ORDER' FROM orders
  UNION ALL SELECT 'l' || rn, 'order:' || l_orderkey, 'part:' || l_partkey, 'HAS_LINE' FROM line
  UNION ALL SELECT DISTINCT 'p' || l_suppkey || '>' || l_partkey, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SUPPLIES' FROM lineitem
  UNION ALL SELECT 'e' || event_id, 'customer:' || user_id, 'event:' || event_id, 'EMITTED' FROM events),
ep AS MATERIALIZED (
  SELECT 'o' || o_orderkey AS eid, 'orderdate' AS k FROM orders
  UNION ALL SELECT 'l' || rn, unnest(CASE WHEN l_discount > 0 THEN ['discount', 'extendedprice', 'quantity', 'tax'] ELSE ['extendedprice', 'quantity', 'tax'] END) FROM line),
nkeys AS (SELECT nodes.node_id, any_value(labels) AS labels, coalesce(list_sort(list(k) FILTER (k IS NOT NULL)), []) AS keys FROM nodes LEFT JOIN np ON np.node_id = nodes.node_id GROUP BY nodes.node_id),
ekeys AS (SELECT e.eid, any_value(e.src) AS src, any_value(e.dst) AS dst, any_value(e.rel) AS rel, coalesce(list_sort(list(k) FILTER (k IS NOT NULL)), []) AS keys FROM edges AS e LEFT JOIN ep ON ep.eid = e.eid GROUP BY e.eid)"""

TYPES = """
nt AS MATERIALIZED (
  SELECT t.labels, any_value(t.n) AS n, coalesce(list_sort(list(k) FILTER (c = t.n)), []) AS mandatory, coalesce(list_sort(list(k) FILTER (c < t.n)), []) AS optional
  FROM (SELECT labels, count(*) AS n FROM nodes GROUP BY 1) AS t
  LEFT JOIN (SELECT labels, k, count(*) AS c FROM nodes JOIN np USING (node_id) GROUP BY 1, 2) AS p ON p.labels = t.labels GROUP BY 1),
ends AS (SELECT e.eid, a.labels AS sl, e.rel, b.labels AS dl FROM edges AS e JOIN nodes AS a ON a.node_id = e.src JOIN nodes AS b ON b.node_id = e.dst),
et AS MATERIALIZED (
  SELECT t.sl, t.rel, t.dl, any_value(t.n) AS n, coalesce(list_sort(list(k) FILTER (c = t.n)), []) AS mandatory, coalesce(list_sort(list(k) FILTER (c < t.n)), []) AS optional
  FROM (SELECT sl, rel, dl, count(*) AS n FROM ends GROUP BY ALL) AS t
  LEFT JOIN (SELECT sl, rel, dl, k, count(*) AS c FROM ends JOIN ep USING (eid) GROUP BY ALL) AS p ON p.sl = t.sl AND p.rel = t.rel AND p.dl = t.dl GROUP BY 1, 2, 3)"""


def q(x: str | list[str] | bool) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "CAST([" + ", ".join(map(q, x)) + "] AS VARCHAR[])"
    return "'" + x.replace("'", "''") + "'"


def schema_values(given: tuple[Schema, ...]) -> str:
    """star_n and star_e: the types of literal schemas."""
    nodes, edges = [], []
    for s in given:
        name, ns, es = s.row()
        nodes += ["(" + ", ".join(map(q, (name, *n))) + ")" for n in ns]
        edges += ["(" + ", ".join(map(q, (name, *e))) + ")" for e in es]
    return f"""
star_n(sid, tid, labels, mandatory, optional) AS (VALUES {", ".join(nodes)}),
star_e(sid, eid, rel, mandatory, optional, src, dst, card) AS (VALUES {", ".join(edges)})"""


#: Every schema and every schema without one type, flattened; v names the variant.
FLATTEN = """
vs(sid, v) AS (SELECT DISTINCT sid, '' FROM star_n UNION ALL SELECT sid, 'n:' || tid FROM star_n UNION ALL SELECT sid, 'e:' || eid FROM star_e WHERE rel <> 'EXTENDS'),
vn AS (SELECT vs.v, n.* FROM vs JOIN star_n AS n ON n.sid = vs.sid AND vs.v <> 'n:' || n.tid),
ve AS (SELECT vs.v, e.* FROM vs JOIN star_e AS e ON e.sid = vs.sid AND vs.v NOT IN ('n:' || e.src, 'n:' || e.dst, 'e:' || e.eid)),
up(sid, v, child, anc, depth) AS (
  SELECT sid, v, src, dst, 1 FROM ve WHERE rel = 'EXTENDS'
  UNION ALL SELECT up.sid, up.v, up.child, ve.dst, depth + 1 FROM up JOIN ve ON ve.sid = up.sid AND ve.v = up.v AND ve.src = up.anc AND ve.rel = 'EXTENDS' AND depth < 12),
above AS (SELECT sid, v, child, anc, min(depth) AS depth FROM up GROUP BY 1, 2, 3, 4),
line_of AS (SELECT sid, v, tid AS child, tid AS anc, 0 AS depth FROM vn UNION ALL SELECT * FROM above),
props AS (
  SELECT l.sid, l.v, l.child, p.prop, arg_min(p.kind, l.depth * 2 + p.kind) AS kind
  FROM line_of AS l JOIN (SELECT sid, v, tid, unnest(mandatory) AS prop, 0 AS kind FROM vn UNION ALL SELECT sid, v, tid, unnest(optional), 1 FROM vn) AS p ON p.sid = l.sid AND p.v = l.v AND p.tid = l.anc GROUP BY 1, 2, 3, 4),
named AS (SELECT l.sid, l.v, l.child AS tid, list_sort(list_distinct(flatten(list(n.labels)))) AS labels FROM line_of AS l JOIN vn AS n ON n.sid = l.sid AND n.v = l.v AND n.tid = l.anc GROUP BY 1, 2, 3),
fn AS MATERIALIZED (
  SELECT n.sid, n.v, n.tid, any_value(n.labels) AS labels, coalesce(list_sort(list(prop) FILTER (kind = 0)), []) AS mandatory, coalesce(list_sort(list(prop) FILTER (kind = 1)), []) AS optional
  FROM named AS n LEFT JOIN props AS p ON p.sid = n.sid AND p.v = n.v AND p.child = n.tid GROUP BY 1, 2, 3),
real AS (SELECT * FROM ve WHERE rel <> 'EXTENDS'),
clan AS (SELECT sid, v, anc AS top, child AS member FROM above UNION SELECT DISTINCT sid, v, anc, anc FROM above),
placed AS (
  SELECT sid, v, rel, mandatory, optional, src, dst, card FROM real
  UNION SELECT r.sid, r.v, rel, mandatory, optional, child, dst, card FROM real AS r JOIN above AS a ON a.sid = r.sid AND a.v = r.v AND a.anc = r.src WHERE src <> dst
  UNION SELECT r.sid, r.v, rel, mandatory, optional, src, child, card FROM real AS r JOIN above AS a ON a.sid = r.sid AND a.v = r.v AND a.anc = r.dst WHERE src <> dst
  UNION SELECT r.sid, r.v, rel, mandatory, optional, x.member, y.member, card FROM real AS r JOIN clan AS x ON x.sid = r.sid AND x.v = r.v AND x.top = r.src JOIN clan AS y ON y.sid = r.sid AND y.v = r.v AND y.top = r.src WHERE src = dst),
fe AS MATERIALIZED (
  SELECT p.*, a.labels AS s_l, a.mandatory AS s_m, a.optional AS s_o, b.labels AS d_l, b.mandatory AS d_m, b.optional AS d_o
  FROM placed AS p JOIN fn AS a ON a.sid = p.sid AND a.v = p.v AND a.tid = p.src JOIN fn AS b ON b.sid = p.sid AND b.v = p.v AND b.tid = p.dst)"""


def dice(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END)"


def node_sim(al: str, am: str, ao: str, bl: str, bm: str, bo: str) -> str:
    return f"(CASE WHEN {dice(al, bl)} = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * {dice(al, bl)} + 0.25::DOUBLE * {dice(am, bm)} + 0.25::DOUBLE * {dice(ao, bo)} END)"


def similarities(endpoint: str = "0.5::DOUBLE", cardinality: str = "0.0::DOUBLE") -> str:
    own = f"(0.5::DOUBLE + 0.25::DOUBLE * {dice('i.mandatory', 's.mandatory')} + 0.25::DOUBLE * {dice('i.optional', 's.optional')})"
    ends = f"(({node_sim('a.labels', 'a.mandatory', 'a.optional', 's.s_l', 's.s_m', 's.s_o')} + {node_sim('b.labels', 'b.mandatory', 'b.optional', 's.d_l', 's.d_m', 's.d_o')}) / 2)"
    return f"""
nsim AS (SELECT s.sid, s.v, s.tid, i.labels AS il, {node_sim("i.labels", "i.mandatory", "i.optional", "s.labels", "s.mandatory", "s.optional")} AS sim FROM fn AS s JOIN nt AS i ON list_has_any(i.labels, s.labels)),
esim AS (
  SELECT s.sid, s.v, s.src, s.rel, s.dst, s.mandatory, s.optional, i.sl, i.dl,
         {endpoint} * {ends} + (1.0::DOUBLE - {endpoint} - {cardinality}) * {own} + {cardinality} * (CASE WHEN s.card THEN 0 ELSE 1 END) AS sim
  FROM fe AS s JOIN et AS i ON i.rel = s.rel AND list_has_any(i.sl, s.s_l) AND list_has_any(i.dl, s.d_l) JOIN nt AS a ON a.labels = i.sl JOIN nt AS b ON b.labels = i.dl),
cov AS MATERIALIZED (
  SELECT vs.sid, vs.v,
         coalesce((SELECT sum(m) FROM (SELECT max(sim) AS m FROM nsim AS x WHERE x.sid = vs.sid AND x.v = vs.v GROUP BY il)), 0.0) / (SELECT count(*) FROM nt) AS nc,
         coalesce((SELECT sum(m) FROM (SELECT max(sim) AS m FROM esim AS x WHERE x.sid = vs.sid AND x.v = vs.v GROUP BY sl, rel, dl)), 0.0) / (SELECT count(*) FROM et) AS ec,
         (SELECT count(*) FROM fe AS f WHERE f.sid = vs.sid AND f.v = vs.v) AS nfe
  FROM vs)"""


CONCISION = """
base AS (
  SELECT c.sid, c.nc, c.ec, c.nfe, (SELECT count(*) FROM star_n AS n WHERE n.sid = c.sid) AS ns,
         (SELECT bool_or(rel = 'EXTENDS') FROM star_e AS e WHERE e.sid = c.sid) AS ext FROM cov AS c WHERE v = ''),
twins AS (SELECT e.sid, 'e:' || e.eid AS v FROM star_e AS e WHERE (SELECT count(*) FROM star_e AS o WHERE o.sid = e.sid AND o.src = e.src AND o.rel = e.rel AND o.dst = e.dst) > 1),
judged AS (
  SELECT c.sid, c.v, b.nc - c.nc < 0.15::DOUBLE * b.nc / b.ns AS n_small, b.ec - c.ec < (CASE WHEN b.nfe = 0 THEN 1.0::DOUBLE ELSE 0.15::DOUBLE * b.ec / b.nfe END) AS e_small,
         b.ext, EXISTS (SELECT 1 FROM twins AS t WHERE t.sid = c.sid AND t.v = c.v) AS twin
  FROM cov AS c JOIN base AS b ON b.sid = c.sid WHERE c.v <> ''),
con AS (
  SELECT sid, 1 - count(*) FILTER (v LIKE 'n:%' AND n_small AND e_small)::DOUBLE / count(*) FILTER (v LIKE 'n:%') AS ncon,
         1 - count(*) FILTER (v LIKE 'e:%' AND CASE WHEN ext THEN n_small AND e_small ELSE twin OR e_small END)::DOUBLE / count(*) FILTER (v LIKE 'e:%') AS econ
  FROM judged GROUP BY sid)"""

SCORE = """SELECT b.sid AS schema_id, round(nc, 6) AS node_coverage, round(ec, 6) AS edge_coverage, round(ncon, 6) AS node_concision, round(econ, 6) AS edge_concision,
  round(CASE WHEN nc + ncon = 0 THEN 0 ELSE 2 * nc * ncon / (nc + ncon) END, 6) AS node_c2, round(CASE WHEN ec + econ = 0 THEN 0 ELSE 2 * ec * econ / (ec + econ) END, 6) AS edge_c2
FROM base AS b JOIN con USING (sid)"""


def graph(select: str, types: bool = False, extra: str = "") -> str:
    return f"WITH RECURSIVE {GRAPH}{',' + TYPES if types else ''}{',' + extra if extra else ''}\n{select}"


def scored(select: str, given: tuple[Schema, ...] = ALL, concision: bool = False, **kinds: str) -> str:
    return graph(select, True, ",".join([schema_values(given), FLATTEN, similarities(**kinds), *([CONCISION] if concision else [])]))


def flattened(select: str, given: tuple[Schema, ...] = ALL) -> str:
    return f"WITH RECURSIVE {schema_values(given)},{FLATTEN}\n{select}"
