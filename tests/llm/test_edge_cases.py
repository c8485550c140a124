"""Every operator over nulls, blanks, ties, repeats, long texts, clashing names and no rows."""

from pyspark.sql import functions as F

from strandgraph.llm import repeats
from strandgraph.llm.jaccard_join import one_of_each, similar_documents
from strandgraph.llm.language_id import held_out, label, train
from strandgraph.llm.license_scan import scan_licenses
from strandgraph.llm.license_texts import LICENSES
from strandgraph.llm.line_dedup import drop_frequent_lines
from strandgraph.llm.media_columns import store_payloads
from strandgraph.llm.mixing import mix_sources, mixed_documents
from strandgraph.llm.packing import encoder, pack
from strandgraph.llm.queries import tokenizer_path
from strandgraph.llm.substring_dedup import dedup_substrings
from strandgraph.llm.suffix_dedup import dedup_suffixes
from strandgraph.llm.topk_search import top_k

from . import brute
from .conftest import odd_documents

NULL = -(2**63)


def pairs():
    return [(NULL if r[0] is None else r[0], r[1]) for r in odd_documents()]


def got(df, *columns):
    return sorted(tuple(NULL if k == 0 and v is None else v for k, v in enumerate(r)) for r in df.select(*columns).collect())


def test_license_scan(odd, empty):
    rows = {r["doc_id"]: r for r in scan_licenses(odd).collect()}
    assert rows[1]["text_digest"] is None and rows[1]["n_notices"] == 0 and rows[2]["license_id"] is None
    assert scan_licenses(empty).count() == 0


def test_license_scan_finds_whole_texts(spark):
    loud = lambda t: "Copyright (c) 2020, A. Person\n" + t.upper().replace(",", " ;").replace("LICENSE", "LICENCE").replace("\n", "  \n")
    docs = [(k, loud(t)) for k, (_, t) in enumerate(LICENSES)] + [(99, LICENSES[0][1] + "\nand more"), (98, "intro\n  released UNDER the mit licence!!\nend")]
    rows = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k]["license_id"] for k in range(len(LICENSES))] == [x for x, _ in LICENSES]
    assert rows[99]["license_id"] is None and rows[98]["notices"] == "MIT" and rows[98]["n_notices"] == 1


def test_substring_dedup(odd, empty):
    want = sorted(brute.substrings(pairs(), 50))
    assert got(dedup_substrings(odd).withColumn("h", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "h") == want
    want = sorted(brute.substrings(pairs(), 6))
    for most in (1, 512):
        assert got(dedup_substrings(odd, window=6, gram=2, most=most).withColumn("h", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "h") == want
    assert dedup_substrings(empty).count() == 0


def test_common_keys_change_nothing(odd, monkeypatch):
    """With every document sampled and every key common, all goes by windows."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "OFTEN", 1)
    rows = got(dedup_substrings(odd, window=6, gram=2).withColumn("h", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "h")
    assert rows == sorted(brute.substrings(pairs(), 6))
    rows = got(dedup_suffixes(odd, window=12, gram=4).withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
    assert {r[0]: r for r in rows} == {r[0]: r for r in brute.suffixes(sorted(set(pairs()), key=str), 12)}


def test_suffix_dedup(odd, empty):
    # Equal rows are one document.
    want = {}
    for r in brute.suffixes(sorted(set(pairs()), key=str), 100):
        want[r[0]] = r
    rows = got(dedup_suffixes(odd).withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
    assert len(rows) == len(pairs()) and {r[0]: r for r in rows} == want
    small = {r[0]: r for r in brute.suffixes(sorted(set(pairs()), key=str), 12)}
    for most in (1, 512):
        rows = got(dedup_suffixes(odd, window=12, gram=4, most=most).withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
        assert {r[0]: r for r in rows} == small
    assert dedup_suffixes(empty).count() == 0


def test_jaccard_join(odd, empty):
    for n, percent in ((3, 90), (2, 60)):
        assert got(similar_documents(odd, n=n, percent=percent, block=2), "doc_id", "n_shingles", F.coalesce("component_id", F.lit(NULL))) == sorted(brute.jaccard(pairs(), n, percent))
    kept = one_of_each(odd)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns and len(ids) == len(set(ids)) and 6 in ids and 7 not in ids and 8 not in ids and None in ids
    assert similar_documents(empty).count() == 0


def test_language_id(odd, empty, spark):
    model = train(odd, per_language=50)
    rows = {r["doc_id"]: r for r in label(odd.drop("score"), model, with_spans=True).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (1, 2, 3, 5))
    assert rows[4]["lang_pred"] != "und" and rows[19]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and len(rows[10]["lang_spans"]) >= 1
    nothing = train(empty)
    assert nothing.languages == [] and {r["lang_pred"] for r in label(odd, nothing).collect()} == {"und"}
    assert label(empty, model).count() == 0
    assert odd.where(F.col("doc_id").isNull()).select(held_out()).head()[0] is False


def test_media_columns(odd, empty):
    rows = {r["doc_id"]: tuple(r)[1:5] for r in store_payloads(odd).collect()}
    assert rows == {i: brute.payload(t) for i, t, *_ in odd_documents()}
    assert store_payloads(empty).count() == 0


def test_packing(odd, empty):
    check_packing(odd_documents(), pack(odd, tokenizer_path()).collect())
    check_packing(odd_documents(), pack(odd, tokenizer_path(), window=16).collect(), 16)
    assert pack(empty, tokenizer_path()).count() == 0


def check_packing(docs, rows, window=1024):
    """Each id in one piece, each sequence gapless, little padding."""
    import zlib

    import numpy as np

    encode = encoder(tokenizer_path())
    want = sorted((NULL if i is None else i, len(encode(t or "")) + 1) for i, t, *_ in docs)
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        pieces.setdefault(NULL if r["doc_id"] is None else r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts: dict = {}
    for i, t, *_ in docs:
        texts.setdefault(NULL if i is None else i, []).append(t)
    assert sorted(pieces) == sorted(texts)
    for i, ts in texts.items():
        expected = []
        for t in ts:
            ids = np.asarray([*encode(t or ""), 0], "<u4")
            expected += [(s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
        assert sorted(pieces[i]) == sorted(expected)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    least = -(-sum(n for _, n in want) // window)
    assert len(sequences) <= least + max(2, least // 50)


def test_line_dedup(odd, empty):
    want = sorted(brute.lines(pairs(), 10))
    for most in (1 << 20, 0):  # keys sent to all tasks, or joined
        out = drop_frequent_lines(odd, broadcast_keys=most)
        assert got(out.withColumn("h", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "h") == want
        assert sorted(out.columns) == sorted([c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"])
    low = sorted(brute.lines(pairs(), 2))
    assert got(drop_frequent_lines(odd, min_docs=2, broadcast_keys=0).withColumn("h", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "h") == low
    assert drop_frequent_lines(empty).count() == 0 and drop_frequent_lines(empty, broadcast_keys=-1).count() == 0


def test_topk_search(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [-1.0, 0.1]), (50, [0.5, 0.25]), (50, [0.0, 1.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0"), k=3).collect()))
    assert [r[1:] for r in out if r[0] == 0] == [(1, 1, 128 * 128 + 64 * 64), (2, 2, 128 * 128 + 64 * 64), (3, 50, 128 * 128 + 64 * 64)]
    assert [r[1:3] for r in out if r[0] == 100] == [(1, 7)]
    named = df.withColumns({"query_id": F.lit("x"), "mark": F.lit("y"), "score": F.lit(1.5), "rank": F.lit("z"), "v": F.lit(None)})
    assert sorted(map(tuple, top_k(named, named.where("vec_id % 50 = 0"), k=3).collect())) == out
    assert top_k(df, df.limit(0)).count() == 0 and top_k(df.limit(0), df.where("vec_id = 0")).count() == 0


def test_topk_search_repeated_queries(spark):
    """A repeated query id has ranks for each of its rows, in one block or in many."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), *((k, [k / 8, 1 - k / 8]) for k in range(1, 9))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")

    def plain(i, v):
        scored = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(v, w, strict=True)), j) for j, w in rows if j != i)
        return [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]

    want = sorted(x for i, v in rows if i % 50 == 0 for x in plain(i, v))
    for block in (4096, 1):
        assert sorted(map(tuple, top_k(df, asked, block=block).collect())) == want


def test_topk_search_large_numbers(spark):
    """Whole numbers beyond doubles are exact, those beyond 64 bits stop at its ends."""
    a = 2.0**20
    rows = [(0, [a, 1.0]), (1, [a, 1.0]), (2, [a, 2.0]), (3, [a, 3.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), k=2).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 2**56 + 3 * 2**16), (0, 2, 2, 2**56 + 2 * 2**16)]
    rows = [(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e200, 0.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id = 0"), k=4).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 4, 0), (0, 4, 2, -(2**63))]


def test_mixing(odd, empty):
    rows = mix_sources(odd).collect()
    assert len(rows) == len(odd_documents()) and {r["source"] for r in rows} == {"a", "b", "c", "abc"[0], None}
    totals = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        totals.setdefault(r["source"], [r["source_size"], r["target"], 0])[2] += r["size"]
    assert all(size == own and target <= 2 * size + 1e-9 for size, target, own in totals.values())
    words = sum(s for s, *_ in totals.values())
    assert abs(sum(t for _, t, _ in totals.values()) - 1.5 * words) < 1e-6
    taken = mixed_documents(odd)
    assert taken.columns == odd.columns and sum(r["copies"] for r in rows) == taken.count()
    assert sorted(map(tuple, mix_sources(odd).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mix_sources(empty).count() == 0
