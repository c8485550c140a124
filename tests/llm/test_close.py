"""The pipeline stage that takes near copies of 5 words and 0.8."""

from glob import glob

import numpy as np
import pyarrow as pa

import corpus_pipeline
from strandgraph.llm import jaccard_join
from strandgraph.llm.shared import shared_folder

from . import brute


def test_close_duplicates(spark, small):
    assert [n for n, _ in corpus_pipeline.CLOSE_STAGES] == [n for n, _ in corpus_pipeline.STAGES]
    words = [f"word{k}" for k in range(50)]
    edited = [(-2, " ".join(words), "en", "a", 1), (-1, " ".join([*words[:25], "other", *words[26:]]), "en", "a", 1)]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(edited, "doc_id long, text string, lang string, source string, n_chars long"))
    stage = dict(corpus_pipeline.CLOSE_STAGES)["ngram_jaccard_join"]
    kept = {r["doc_id"] for r in stage(spark, docs, small).select("doc_id").collect()}
    assert kept == {i for i, _, c in brute.jaccard([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80) if i == c}
    assert -2 in kept and -1 not in kept


def test_stages_leave_one_table(spark, small):
    tables = f"{shared_folder(spark).removeprefix('file:')}/*/_SUCCESS"
    before = set(glob(tables))
    assert corpus_pipeline.run_close(spark, small).count()
    assert len(set(glob(tables)) - before) == 1


def test_blocks_in_turns(spark, monkeypatch):
    """Families' blocks go through the shuffle in several turns, and no link is lost."""
    base = [f"word{k}" for k in range(40)]
    rows = [(100 * a + b, " ".join([f"own{a}x{k}" if k % 6 == 0 and a else w for k, w in enumerate(base)] + [f"end{a}"] * (b % 3))) for a in range(6) for b in range(5)]
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 20)
    monkeypatch.setattr(jaccard_join, "SETS_AT_ONCE", 0)
    turns, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda *given: turns.append(given) or links(*given))
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=50, block=4)
    assert len(turns) > 2  # stars, and at least two turns
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute.jaccard(rows, 2, 50))


def test_sketches_lose_no_pair():
    """Pairs that are similar stay whatever the sizes of their sketches; no stranger does here."""
    rng = np.random.default_rng(7)
    texts = []
    for size in (7, 40, 230, 250, 257, 500, 520, 1000, 1030, 3000):
        base = [f"w{x}" for x in rng.integers(0, 10**9, size)]
        for change in (0, 0.05, 0.11, 0.2):
            own = base.copy()
            own[: int(size * change)] = [f"w{x}" for x in rng.integers(0, 10**9, int(size * change))]
            texts += [" ".join(own), " ".join([*own, *(f"w{x}" for x in rng.integers(0, 10**9, size // 12))])]
    data, offsets = jaccard_join.flat(pa.array(texts))
    sets = jaccard_join.Sets(data, offsets, 2, jaccard_join.Powers())
    left, right = np.arange(0, len(texts), 2), np.arange(len(texts))
    for percent in (80, 90):
        x, y = jaccard_join.close_sketches(sets.sizes, *jaccard_join.sketch(sets), left, right, percent)
        found = set(zip(x.tolist(), y.tolist(), strict=True))
        assert len(found) == len(x)
        p, q = jaccard_join.overlaps(sets.value, sets.offsets, left, right, percent)
        assert set(zip(left[p].tolist(), q.tolist(), strict=True)) <= found
        assert all(a // 8 == b // 8 for a, b in found)  # of one base


def test_strangers_of_one_family_do_not_all_meet(spark, monkeypatch):
    """Strangers of common words are one family; only those that share a part meet, and few of their sets are multiplied."""
    rng = np.random.default_rng(11)
    rows = [(k, " ".join([f"common{x}" for x in rng.permutation(60)[:12]] + [f"own{k}x{j}" for j in range(18)])) for k in range(240)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(0, 240, 3)]
    met = []
    for name in ("_close", "_links"):
        if step := getattr(jaccard_join, name, None):
            monkeypatch.setattr(jaccard_join, name, lambda part, *given, name=name, step=step: met.append((name, part.count())) or step(part, *given))
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=80, block=2)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute.jaccard(rows, 1, 80))
    assert sum(n for name, n in met if name == "_links") < 2000, met
