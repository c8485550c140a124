"""A training corpus from the documents table, stage by stage.

Every stage takes all rows its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces.  ``run`` writes each stage's
rows to the shared checkpoint folder and reads them again, so that a lost
executor costs one stage at most.  A stage's rows are deleted when the next one has
written its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.jaccard_join import one_of_each
from strandgraph.llm.language_id import NONE, label, train
from strandgraph.llm.line_dedup import drop_frequent_lines
from strandgraph.llm.mixing import mixed_documents
from strandgraph.llm.packing import pack
from strandgraph.llm.queries import read, tokenizer_path
from strandgraph.llm.shared import new_folder, removed, tidy, written

#: Least mean probability of a document's language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of no clear language, go."""
    marked = label(docs, train(docs))
    return marked.where((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have."""
    kept = drop_frequent_lines(docs, min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.9 of 3-word shingles."""
    return one_of_each(docs, n=3, percent=90)


def close_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    return one_of_each(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 ids."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


#: The same with the wider near-duplicate stage, which also takes short and lightly edited copies.
CLOSE_STAGES = [(name, close_duplicates if stage is near_duplicates else stage) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = STAGES) -> DataFrame:
    docs, past = read(spark, sf_dir, "documents"), None
    for name, stage in stages:
        docs = stage(spark, docs, sf_dir)
        if name != stages[-1][0]:
            docs = written(docs, path := new_folder(spark))
            if past:
                removed(spark, past)
            past = path
            tidy(spark)
    return docs


def run_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, CLOSE_STAGES)


#: A conditional random field, a tokenizer and bin packing are beyond SQL; tests compare a plain version.
ORACLE_SQL = None
