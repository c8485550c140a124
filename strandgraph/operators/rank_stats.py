"""Agreement of rankings: Borda counts, Kendall's W, its chi-square test, Kendall's tau-b.

Ranks are rows (rater, question, item, rank), a wide table unpivoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns named Q1-2-A hold the rank of item A of question Q1-2.
COLUMN = r"^(Q\d+-\d+)-([A-Z])$"


def unpivot(table: DataFrame, name: str = "name") -> DataFrame:
    """rater, question, item, rank of a table with a row a rater; blanks are null ranks."""
    import re

    columns = [c for c in table.columns if re.match(COLUMN, c)]
    long = table.select(F.col(name).alias("rater"), *(F.col(f"`{c}`").try_cast("int").alias(c) for c in columns)).unpivot("rater", columns, "column", "rank")
    return long.select("rater", F.regexp_extract("column", COLUMN, 1).alias("question"), F.regexp_extract("column", COLUMN, 2).alias("item"), "rank")


def complete(ranks: DataFrame, permutations: bool = True) -> DataFrame:
    """Rows of raters who ranked every item of a question; with ``permutations`` by 1..n, each once."""
    of = Window.partitionBy("rater", "question")
    ok = F.count("rank").over(of) == F.count("*").over(of)
    if permutations:
        ok = ok & (F.sort_array(F.collect_list("rank").over(of)) == F.sequence(F.lit(1), F.count("*").over(of).cast("int")))
    return ranks.withColumn("_ok", ok).where("_ok").drop("_ok")


def borda(ranks: DataFrame) -> DataFrame:
    """question, item, points: n - rank summed over complete rankings."""
    n = F.count("*").over(Window.partitionBy("rater", "question"))
    return complete(ranks).withColumn("p", n - F.col("rank")).groupBy("question", "item").agg(F.sum("p").alias("points"))


def golden(ranks: DataFrame) -> DataFrame:
    """question, item, points, rank: by points, ties by item."""
    return borda(ranks).withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("points"), "item")))


def with_golden(ranks: DataFrame, name: str = "GOLDEN") -> DataFrame:
    """The ranks with the golden ranking first, in place of an earlier one."""
    rows = ranks.where(F.col("rater") != name)
    best = golden(rows.where(F.col("rater") != "PROPOSED")).select(F.lit(name).alias("rater"), "question", "item", "rank")
    return best.unionByName(rows)


def kendall_w(ranks: DataFrame) -> DataFrame:
    """question, raters, items, w: agreement of complete rankings, ties corrected."""
    rows = complete(ranks, permutations=False)
    sums = rows.groupBy("question", "item").agg(F.sum("rank").alias("r"))
    spread = sums.groupBy("question").agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum("r").alias("s"))
    raters = rows.groupBy("question").agg(F.count_distinct("rater").alias("m"))
    ties = rows.groupBy("question", "rater", "rank").agg(F.count("*").alias("t")).groupBy("question").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    m, n = F.col("m"), F.col("n")
    top = 12.0 * (F.col("rr") - F.col("s") * F.col("s") / n)
    bottom = m * m * (n * n * n - n) - m * F.col("ties")
    joined = spread.join(raters, "question").join(ties, "question")
    return joined.select("question", m.alias("raters"), n.alias("items"), F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0)).alias("w"))


def chi_square_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution: the finite sums for even and odd degrees of freedom."""
    import math

    half = x / 2.0
    odd_start = erfc(F.sqrt(half))
    # Terms of both sums follow from the one before: times x/2 over the next (half) integer.
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((df - 1) / 2).cast("int")))
    even = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * half / k).alias("t"), F.when(k * 2 < df, a["s"] + a["t"] * half / k).otherwise(a["s"]).alias("s")))["s"]
    first = F.sqrt(half) * (2.0 / math.sqrt(math.pi))
    odd = F.aggregate(steps, F.struct(first.alias("t"), F.lit(0.0).alias("s")), lambda a, k: F.struct((a["t"] * half / (k + 0.5)).alias("t"), F.when(k * 2 < df, a["s"] + a["t"]).otherwise(a["s"]).alias("s")))["s"]
    return F.when(x <= 0, F.lit(1.0)).when(df % 2 == 0, F.exp(-half) * even).otherwise(odd_start + F.exp(-half) * odd)


def erfc(z: Column) -> Column:
    """The complementary error function for z >= 0: its series below 3, its continued fraction above."""
    import math

    terms = F.sequence(F.lit(1), F.lit(80))
    series = F.aggregate(terms, F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((-a["t"] * z * z / k).alias("t"), (a["s"] - a["t"] * z * z / k / (2 * k + 1)).alias("s")))["s"]
    fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(60))), z, lambda a, k: z + k / 2.0 / a)
    return F.when(z < 3, 1.0 - series * (2.0 / math.sqrt(math.pi))).otherwise(F.exp(-z * z) / fraction / math.sqrt(math.pi))


def kendall_w_test(ranks: DataFrame) -> DataFrame:
    """question, w, chi2, df, p of the hypothesis of no agreement."""
    rows = kendall_w(ranks)
    chi = F.col("raters") * (F.col("items") - 1) * F.col("w")
    rows = rows.select("question", "w", chi.alias("chi2"), (F.col("items") - 1).alias("df"))
    return rows.withColumn("p", chi_square_tail(F.col("chi2"), F.col("df")))


def kendall_tau(ranks: DataFrame, reference: DataFrame) -> DataFrame:
    """rater, question, tau: tau-b of each rater's complete ranking against the reference (question, item, rank)."""
    ref = reference.select("question", "item", F.col("rank").alias("ref"))
    rows = complete(ranks, permutations=False).join(ref, ["question", "item"])
    a, b = (rows.select("rater", "question", F.col("item").alias(f"i{x}"), F.col("rank").alias(f"r{x}"), F.col("ref").alias(f"g{x}")) for x in "ab")
    pairs = a.join(b, ["rater", "question"]).where("ia < ib")
    one, two = F.signum(F.col("ra") - F.col("rb")), F.signum(F.col("ga") - F.col("gb"))
    sums = pairs.groupBy("rater", "question").agg(F.sum(one * two).alias("c"), F.sum(F.abs(one)).alias("x"), F.sum(F.abs(two)).alias("y"))
    return sums.select("rater", "question", F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("c") / F.sqrt(F.col("x") * F.col("y"))).alias("tau"))


def mean_tau(ranks: DataFrame, reference: DataFrame) -> DataFrame:
    """rater, tau, questions: the mean over the questions that have one."""
    return kendall_tau(ranks, reference).where("tau is not null").groupBy("rater").agg(F.avg("tau").alias("tau"), F.count("*").alias("questions"))
