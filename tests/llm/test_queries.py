"""The registered queries against SQL and plain versions, and the pipeline stage by stage."""

import pytest

from strandgraph.llm.oracle import oracle_sql
from strandgraph.llm.packing import pack
from strandgraph.llm.queries import queries, tokenizer_path

from ..oracle import compare
from . import brute
from .test_edge_cases import check_packing


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, medium, name):
    assert compare(spark, queries()[name], oracle_sql()[name], medium) > 0


@pytest.fixture(scope="module")
def docs(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def rows(spark, small, name):
    return sorted(map(tuple, queries()[name](spark, small).collect()))


def test_op2(spark, small, docs):
    assert rows(spark, small, "op2_substring_dedup") == brute.substrings([d[:2] for d in docs], 50)


def test_op3(spark, small, docs):
    assert rows(spark, small, "op3_ngram_jaccard_join") == brute.jaccard([d[:2] for d in docs], 3, 90)


def test_op5(spark, small, docs):
    assert {r[0]: r[1:5] for r in rows(spark, small, "op5_media_columns")} == {d[0]: brute.payload(d[1]) for d in docs}


def test_op6(spark, small, docs):
    check_packing(docs, queries()["op6_packing"](spark, small).collect())


def test_op9(spark, small, docs):
    assert rows(spark, small, "op9_suffix_dedup") == brute.suffixes([d[:2] for d in docs], 100)


def test_pipeline(spark, small, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = now.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.written(stage(spark, now, small))
        assert now.columns == columns, name
        after = [tuple(r) for r in now.select("doc_id", "text", "lang", "source").collect()]
        if name == "language_id":
            assert {d[0] for d in before} - {d[0] for d in after} <= {d[0] for d in before if sum(c.isalpha() for c in d[1] or "") < 40}
        elif name == "line_dedup":
            want = {r[0]: r[3] for r in brute.lines([d[:2] for d in before], 10)}
            assert {d[0]: brute.sha(d[1]) for d in after} == want
        elif name == "ngram_jaccard_join":
            assert {d[0] for d in after} == {i for i, _, c in brute.jaccard([d[:2] for d in before], 3, 90) if i == c}
        else:
            copies = {}
            for d in after:
                copies[d[0]] = copies.get(d[0], 0) + 1
            assert max(copies.values()) <= 2 and set(copies) <= {d[0] for d in before}
        before = after
    check_packing(before, pack(now, tokenizer_path()).collect())
    assert pipeline.run(spark, small).count() == pipeline.STAGES[-1][1](spark, now, small).count()
