"""The parts the operators are made of: round trips, brute force, held-out accuracy."""

import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import media_columns as mc
from strandgraph.llm import components as components_module
from strandgraph.llm.components import components
from strandgraph.llm.kernels import Polynomial, Words, flat, pieces, sliding_min, union_spans
from strandgraph.llm.language_id import fit, label, marginals
from strandgraph.llm.packing import encoder, fill, patterns, places
from strandgraph.llm.queries import op4_language_id, tokenizer_path
from strandgraph.llm.shared import tidy
from strandgraph.llm.suffix_dedup import BlindTries, common

from . import brute

texts = st.lists(st.text(alphabet="ab \n\tÜ0", max_size=40), min_size=1, max_size=6)


@settings(deadline=None)
@given(texts)
def test_words(ts):
    data, offsets = flat(pa.array(ts))
    words = Words(data, offsets)
    found = [[data[a:b].tobytes().decode() for a, b in zip(words.start[i:j], words.end[i:j], strict=True)] for i, j in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    assert found == [brute.WORD.findall(t) for t in ts]
    hashes = words.hashes()
    flat_words = [w for d in found for w in d]
    assert len(set(hashes.tolist())) == len(set(flat_words))


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min_and_grams(values, width):
    x = np.asarray(values, np.uint64)
    assert sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    grams = Polynomial(x).grams(width)
    assert len(grams) == max(0, len(values) - width + 1)
    seen = {}
    for i, g in enumerate(grams.tolist()):
        assert seen.setdefault(tuple(values[i : i + width]), g) == g


def test_pieces_and_spans():
    offsets = np.asarray([0, 5, 5, 100, 101, 300])
    parts = list(pieces(offsets, 50))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    a, b = union_spans(np.asarray([5, 0, 2, 9]), np.asarray([7, 2, 3, 11]))
    assert a.tolist() == [0, 5, 9] and b.tolist() == [3, 7, 11]


def test_blind_tries():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 99, 400).astype(np.uint8))
    window = 9
    tries, first = BlindTries(text, window), {}
    for at in range(len(text) - window + 1):
        assert tries.insert(0, at) == first.get(text[at : at + window])
        first.setdefault(text[at : at + window], at)
    assert common(b"abcd", b"abxd") == 2 and common(b"", b"a") == 0 and common(b"ab", b"abc") == 2


def test_companding_tables():
    mu, a = mc.mulaw_table(), mc.alaw_table()
    assert mu[0xFF] == mu[0x7F] == 0 and mu[0x00] == -32124 and mu[0x80] == 32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0x2A] == -32256 and a[0xAA] == 32256
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_media_round_trip():
    codes = bytes(range(256)) * 3
    for codec in ("mulaw", "alaw"):
        kind, rate, block, back = mc.read(mc.store(codes, codec))
        assert (kind, rate, bytes(back)) == (codec, 8000, codes)
    with pytest.raises(ValueError):
        mc.read(b"not audio at all")
    with pytest.raises(ValueError):
        mc.read(mc.store(b"x")[:-2].replace(b"\x07\x00\x01", b"\x01\x00\x01"))


def test_adpcm():
    per = 2 * 256 - 7
    t = np.arange(4 * per)
    wave = (8000 * np.sin(t / 9.0) + 3000 * np.sin(t / 31.0)).astype(np.int16)
    back = mc.decode_ima(mc.encode_ima(wave))
    assert len(back) == len(wave)
    steady = np.arange(len(wave)) % per > 40
    assert np.abs(back.astype(int) - wave)[steady].mean() < 300
    kind, _, block, codes = mc.read(mc.store(mc.encode_ima(wave).tobytes(), "ima"))
    assert kind == "ima" and block == 256 and np.array_equal(mc.decode_ima(np.frombuffer(codes, np.uint8), block), back)


def test_resampling():
    pcm = np.asarray([0, 100, -100], np.int16)
    assert mc.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert len(mc.resample(pcm, 8000, 12000)) == 4 and mc.resample(pcm, 8000, 8000) is pcm


def test_decode_column(spark):
    media = [mc.store(bytes(range(200)), "alaw"), mc.store(mc.encode_ima(np.zeros(505, np.int16)).tobytes(), "ima"), None]
    rows = mc.decode_telephony(spark.createDataFrame([(k, m) for k, m in enumerate(media)], "id int, media binary")).orderBy("id").collect()
    assert len(rows[0]["pcm"]) == 2 * 400 and rows[0]["pcm_rate"] == 16000 and len(rows[1]["pcm"]) == 2 * 1010 and rows[2]["pcm"] is None


def test_encoder_is_the_tokenizer():
    encode, plain = encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("", "Hello  world's 123 \n\n x", "Übergrößen 😀 été", "a<|endoftext|>b", " " * 50 + "z", "x" * 3000, "\t\r\n  y", "l'été d'or I'll we've"):
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=8))
def test_patterns_use_everything_once(counts):
    found = patterns(counts, 64)
    used = {}
    for times, pattern in found:
        assert sum(k * n for k, n in pattern) <= 64
        for k, n in pattern:
            used[k] = used.get(k, 0) + times * n
    assert used == counts
    for length, runs in places(found).items():
        at = 0
        for first, n, *_ in sorted(runs):
            assert first == at
            at += n
        assert at == counts[length]


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 40))
def test_fill_is_closest(counts, capacity):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * c for s in sums for c in range(n + 1)}
    picked = fill(counts, capacity)
    assert sum(k * n for k, n in picked.items()) == max(s for s in sums if s <= capacity)
    assert all(n <= counts[k] for k, n in picked.items())


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_few_jobs(spark, monkeypatch):
    """Every job of the driver costs it memory; the steps for more edges than one task takes agree."""
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-500, 500, (700, 2))] + [(k, k + 1) for k in range(1000, 1300)], "a long, b long")
    spark.sparkContext.setJobGroup("few jobs", "components")
    got = sorted(components(edges).collect())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) <= 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(components_module, "ONE_TASK", 0)
    assert sorted(components(edges).collect()) == got


def test_tidy_gives_memory_back(spark):
    """What is freed between pieces that stay leaves the driver's process."""
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    pieces_, stay = [], []
    for _ in range(3000):
        pieces_.append(np.ones(100_000, np.uint8))
        stay.append(np.ones(1000, np.uint8))
    del pieces_
    before = resident()
    tidy(spark)
    assert before - resident() > 150


def test_forward_backward():
    rng = np.random.default_rng(5)
    lengths = [1, 0, 3, 130, 49]
    offsets = np.r_[0, np.cumsum(lengths)]
    scores, transition = rng.normal(size=(offsets[-1], 3)), rng.normal(size=(3, 3))
    got, pairs = marginals(scores, offsets, transition, True)
    total = np.zeros((3, 3))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if a == b:
            continue
        e, t = np.exp(scores[a:b]), np.exp(transition)
        f, g = [e[0] / e[0].sum()], [np.ones(3)]
        for k in range(1, b - a):
            x = (f[-1] @ t) * e[k]
            f.append(x / x.sum())
        for k in range(b - a - 1, 0, -1):
            x = t @ (e[k] * g[-1])
            g.append(x / x.sum())
        g = g[::-1]
        want = np.asarray(f) * np.asarray(g)
        assert np.allclose(want / want.sum(1, keepdims=True), got[a:b])
        for k in range(1, b - a):
            x = f[k - 1][:, None] * t * (e[k] * g[k])[None, :]
            total += x / x.sum()
    assert np.allclose(total, pairs)


def test_code_switching(spark):
    model = fit({"up": ["alpha beta gamma delta alpha beta"] * 30, "down": ["uno dos tres cuatro uno dos"] * 30})
    df = spark.createDataFrame([(1, "alpha beta gamma alpha uno dos tres cuatro")], "doc_id long, text string")
    spans = label(df, model, with_spans=True).head()["lang_spans"]
    assert [(s["first"], s["words"], s["lang"]) for s in spans] == [(0, 4, "up"), (4, 4, "down")]


def test_held_out_accuracy(spark, medium):
    truth = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, medium).join(truth, "doc_id").where("held_out")
    right, n = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert n > 200 and right / n > 0.97
    assert {r["held_out"] for r in op4_language_id(spark, medium).where("doc_id < 50").select("doc_id", "held_out").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2} <= {True}


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_part(percent):
    """No pair of similar sets is lost, of any size, also where parts stay empty."""
    from types import SimpleNamespace

    from strandgraph.llm.jaccard_join import part_keys

    rng = np.random.default_rng(percent)
    values, sizes, pairs = [], [], []
    for n in [*range(2, 40), 57, 100, 333, 1000] * 6:
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        shared = int(np.ceil(n * percent / 100))
        drop = int(rng.integers(0, n - shared + 1))
        other = base[: n - drop]
        extra = max(0, int((n - drop) * 100 // percent) - n)
        other = np.r_[other, rng.integers(0, 2**63, int(rng.integers(0, extra + 1)), dtype=np.uint64)]
        both = len(np.intersect1d(base, other))
        if 100 * both >= percent * (len(base) + len(other) - both) and len(base) != both:
            pairs.append((len(sizes), len(sizes) + 1))
        for s in (base, other):
            values.append(np.sort(s))
            sizes.append(len(s))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sets = SimpleNamespace(doc=doc, value=np.concatenate(values), sizes=np.asarray(sizes))
    keys, of = part_keys(sets, np.arange(len(sizes)), percent)
    own = [set() for _ in sizes]
    for k, o in zip(keys.tolist(), of.tolist(), strict=True):
        own[o].add(k)
    assert len(pairs) > 30 and all(own[a] & own[b] for a, b in pairs)
    strangers = sum(bool(own[a] & own[b]) for a in range(0, 200, 2) for b in range(a + 2, 200, 2))
    assert strangers <= {60: 5000, 80: 300, 90: 2}[percent], strangers
