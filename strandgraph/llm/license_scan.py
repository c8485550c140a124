"""Find known licences by the digests of canonical texts, in DataFrame operations.

A text's canonical form has A-Z lower-cased, everything but letters, marks and
digits of any script turned to single spaces, lines that state a copyright
dropped, line breaks made spaces, and equivalent spellings made one.  Where the
lines are broken does not matter, as a line states a copyright only if a year, a
sign or a holder follows the word; a statement that shares its line with other
text takes that text along.  The digest of the whole canonical text is joined to
the digests of known licences; single lines are looked up among known notices
("Released under the MIT License.").

Known texts are a small table, so both look-ups stay within one scan and nothing
is shuffled; a table of over ``BROADCAST_LICENSES`` texts is joined as Spark sees
fit.

Defined results: a null text has no digest, no licence, no notices; an empty text
has the digest of the empty form and no licence; a row with a null id keeps it;
repeated rows give repeated results; very long texts are handled like others; of
several names for one canonical text the smallest is given; columns of the input
do not pass, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, EQUIVALENTS, LICENSES, NOTICES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but letters, marks, digits and line feeds.
BREAK = r"[^\n\p{L}\p{M}\p{N}]+"
#: A canonical line that states a copyright: a year, a sign or a holder follows.
STATED = r"^((portions )?copyright (c |by |[12][0-9]{3})|c [12][0-9]{3}|all rights reserved$)"
HOLDER = r"^copyright [\p{L}]"
#: How text of a licence goes on after the word, where that begins a line.
BODY = (
    r"^copyright (also|and|as|assignment|disclaimer|doctrines?|for|holders?|in|interests?|is|laws?|licenses?|like|line|notices?|of|on|or|owners?"
    r"|patents?|permission|protection|rights?|software|statements?|status|that|the|this|to|treaty|under|which|with|year)( |$)"
)
#: Most licence texts that are sent to all tasks, and most notices, which become part of the plan.
BROADCAST_LICENSES, NOTICES_MOST = 100_000, 1000


def _spelt(text: Column) -> Column:
    for old, new in EQUIVALENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines that are neither blank nor state a copyright."""
    signs = F.regexp_replace(F.translate(text, UPPER, LOWER), "[\u00a9\u24b8\u2117]", " c ")
    lines = F.transform(F.split(_spelt(F.regexp_replace(signs, BREAK, " ")), "\n"), lambda x: F.trim(x))
    stated = lambda x: x.rlike(STATED) | (x.rlike(HOLDER) & ~x.rlike(BODY))
    return F.filter(lines, lambda x: (x != "") & ~(x.rlike("^(portions |c [12]|copyright|all rights)") & stated(x)))


def whole(lines: Column) -> Column:
    return F.sha2(_spelt(F.array_join(lines, " ")), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    rows = spark.createDataFrame(texts, "license_id string, text string").select("license_id", whole(canonical_lines(F.col("text"))).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_lines(spark: SparkSession, notices: list[tuple[str, str]]) -> dict[str, str]:
    """The name of each canonical notice."""
    if len(notices) > NOTICES_MOST:
        raise ValueError(f"at most {NOTICES_MOST} notices can be looked up")
    rows = spark.createDataFrame(notices, "license_id string, text string")
    rows = rows.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("line"))
    return {r["line"]: r["license_id"] for r in rows.groupBy("line").agg(F.min("license_id").alias("license_id")).orderBy("line").collect()}


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id", licenses: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest, license_id, n_notices, notices (ids in order, comma between)."""
    spark = df.sparkSession
    own = licenses is None
    known = known_digests(spark, LICENSES if own else licenses, DIGESTS if own else []).withColumnRenamed("digest", "text_digest")
    lines = known_lines(spark, NOTICES if notices is None else notices)
    named = F.array().cast("array<string>")
    if lines:
        table = F.create_map(*(F.lit(x) for pair in lines.items() for x in pair))
        named = F.coalesce(F.transform(F.filter("lines", lambda x: x.isin(list(lines))), lambda x: table[x]), named)
    canonical = df.select(F.col(doc_id).cast("long").alias("doc_id"), canonical_lines(F.col(text).cast("string")).alias("lines"))
    found = canonical.select("doc_id", whole(F.col("lines")).alias("text_digest"), named.alias("named"))
    few = len(LICENSES if own else licenses) <= BROADCAST_LICENSES
    joined = found.join(F.broadcast(known) if few else known, "text_digest", "left")
    return joined.select("doc_id", "text_digest", "license_id", F.size("named").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("notices"))
