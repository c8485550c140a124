"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .license_texts import DIGESTS, EQUIVALENTS, LICENSES, NOTICES

SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spelt(x: str) -> str:
    for old, new in EQUIVALENTS:
        x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
    return x


#: Words that go on a licence's own sentence where a line begins with "copyright".
SENTENCE = """also and as assignment disclaimer doctrine doctrines for holder holders in interest interests is law laws license licenses like line
notice notices of on or owner owners patent patents permission protection right rights software statement statements status that the
this to treaty under which with year""".split()


def _licenses() -> str:
    marked = f"replace(replace(replace(translate(text, '{UPPER}', '{LOWER}'), chr(169), ' c '), chr(9400), ' c '), chr(8471), ' c ')"
    clean = _spelt(f"regexp_replace({marked}, '[^\\n\\pL\\pM\\pN]+', ' ', 'g')")
    year = "regexp_matches(string_split(x, ' ')[{}], '^[12][0-9][0-9][0-9]')"
    second = "string_split(x, ' ')[2]"
    states = f"""(x = 'all rights reserved' OR (string_split(x, ' ')[1] = 'c' AND {year.format(2)})
      OR (starts_with(x, 'portions copyright ') AND (starts_with(x, 'portions copyright c ') OR starts_with(x, 'portions copyright by ') OR {year.format(3)}))
      OR (starts_with(x, 'copyright ') AND ({year.format(2)} OR starts_with(x, 'copyright c ') OR starts_with(x, 'copyright by ')
          OR (regexp_matches({second}, '^\\pL') AND {second} NOT IN ({", ".join(map(_quoted, SENTENCE))})))))"""
    lines = f"list_filter(list_transform(string_split({clean}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT {states})"
    whole = f"sha256({_spelt("coalesce(array_to_string(lines, ' '), '')")})"
    values = lambda rows: ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows)
    kept = lambda rows: f"(SELECT id, {lines} AS lines FROM (VALUES {values(rows)}) AS v(id, text))"
    more = f" UNION ALL SELECT * FROM (VALUES {values((b, a) for a, b in DIGESTS)})" if DIGESTS else ""
    return f"""
WITH licenses AS (SELECT digest, min(id) AS id FROM (SELECT {whole} AS digest, id FROM {kept(LICENSES)}{more}) GROUP BY 1),
notices AS (SELECT array_to_string(lines, ' ') AS notice, min(id) AS id FROM {kept(NOTICES)} GROUP BY 1),
doc AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {whole} END AS text_digest, lines
        FROM (SELECT doc_id, text, {lines} AS lines FROM documents)),
hit AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
        FROM (SELECT doc_id, unnest(lines) AS line FROM doc) AS l JOIN notices ON line = notice GROUP BY 1)
SELECT doc.doc_id, text_digest, licenses.id AS license_id, coalesce(hit.n, 0) AS n_notices, coalesce(hit.ids, '') AS notices
FROM doc LEFT JOIN licenses ON text_digest = licenses.digest LEFT JOIN hit ON hit.doc_id = doc.doc_id"""


LINES = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS k FROM line),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 5"""

MIXING = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(list_extract([5, 2, 1], CAST(n % 3 + 1 AS BIGINT)) AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM src),
-- each step fills the sources that the level of the rest would overflow
fill(step, done, level) AS (
  SELECT 0, CAST([] AS BIGINT[]), (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM weighed)
  UNION ALL
  SELECT step + 1, newly, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (list_contains(newly, n)), 0)) / sum(w) FILTER (NOT list_contains(newly, n)) FROM weighed)
  FROM (SELECT step, done, (SELECT coalesce(list(n ORDER BY n), []) FROM weighed WHERE w * level > cap) AS newly FROM fill)
  WHERE len(newly) > len(done)),
top AS (SELECT arg_max(level, step) AS level FROM fill),
goal AS (SELECT weighed.*, least(cap, w * level) AS target,
         CAST(('0x' || substr(md5(coalesce(source, '') || '|17'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM weighed, top),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, ((doc_id % 64) + 64) % 64, doc_id) - 1 AS p FROM sized),
rated AS (
  SELECT placed.doc_id, size, source_size, target, start, p, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM placed JOIN goal ON placed.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST(size * (floor((p + 1) * rate + start) - floor(p * rate + start)) AS BIGINT) AS taken
FROM rated"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _licenses(), "op7_line_dedup": LINES, "op8_topk_search": TOP_K, "op10_mixing": MIXING}
