"""Inputs on which weak hashes collide: Thue-Morse strings and their complements."""

import textwrap
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import repeats
from strandgraph.llm.jaccard_join import similar_documents
from strandgraph.llm.license_scan import scan_licenses
from strandgraph.llm.license_texts import DIGESTS, LICENSES
from strandgraph.llm.line_dedup import drop_frequent_lines
from strandgraph.llm.packing import encoder, pack
from strandgraph.llm.queries import tokenizer_path
from strandgraph.llm.substring_dedup import dedup_substrings
from strandgraph.llm.suffix_dedup import dedup_suffixes

from tokenizers import Tokenizer

from . import brute

X = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
Y = X.translate(str.maketrans("ab", "ba"))
WORDS = [f"w{k}" for k in range(49)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_lines_of_one_weak_hash_stay(spark, most):
    texts = [X] * 5 + [Y] * 5
    out = drop_frequent_lines(frame(spark, texts), broadcast_keys=most).withColumn("h", F.sha2("text", 256))
    assert got(out, "doc_id", "n_lines", "n_dropped", "h") == sorted(brute.lines(list(enumerate(texts, 1)), 10))
    assert all(r[2] == 0 for r in got(out, "doc_id", "n_lines", "n_dropped"))


def test_shingles_of_one_weak_hash_differ(spark):
    texts = [f"{X} p q", f"{Y} p q", f"{X} p q"]
    assert got(similar_documents(frame(spark, texts), n=3, percent=90), "doc_id", "n_shingles", "component_id") == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


@pytest.mark.parametrize("common", [False, True])
def test_windows_of_one_weak_hash_stay(spark, monkeypatch, common):
    if common:
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "OFTEN", 1)
    texts = [" ".join([X, *WORDS]), " ".join([Y, *WORDS]), " ".join([X, *WORDS])]
    for most in (1, 512):
        out = dedup_substrings(frame(spark, texts), most=most).withColumn("h", F.sha2("text", 256))
        assert got(out, "doc_id", "n_words", "n_removed", "h") == sorted(brute.substrings(list(enumerate(texts, 1)), 50))


def test_bytes_of_one_weak_hash_stay(spark):
    texts = [X + "p" * 30, Y + "q" * 30, X + "r" * 30]
    for window in (100, 1024):
        out = dedup_suffixes(frame(spark, texts), window=window).withColumn("h", F.sha2("kept", 256))
        assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == sorted(brute.suffixes(list(enumerate(texts, 1)), window))


LONG = {"spaces": " " * 2_000_000 + "x", "newlines": "\n" * 2_000_000 + "x", "wide": "\u3000" * 1_200_000, "letters": "a" * 2_000_000, "dashes": "-" * 2_000_000}


@pytest.mark.parametrize("name", LONG)
def test_long_runs_pack_to_the_ids_of_tokenizers(spark, name):
    text = LONG[name]
    ids = np.asarray([*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 0], "<u4")
    want = [(1, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert got(pack(frame(spark, [text]), tokenizer_path()), "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want


@pytest.mark.parametrize("n", [498, 499, 500, 501, 998, 999, 1000, 1001, 1499, 1500, 5000])
def test_runs_about_the_bound(n):
    quick, plain = encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in (" " * n, "ab" + "\n" * n + "c", "é \u00a0" * (n // 3) + "d", "x" * 250 + " \t" * (n // 2) + " word" * 300):
        assert quick(text) == plain.encode(text, add_special_tokens=False).ids


def rewrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def test_licenses_are_found_however_wrapped(spark):
    docs, want = [], {}
    for name, text in LICENSES:
        statement = "Copyright (c) 2020, A. Person\nCopyright 1999-2004 B. Person. All rights reserved.\n\u00a9 2001 C\nCopyright D. Person\n\n"
        forms = [rewrapped(text, w) for w in range(40, 121)] + [" ".join(text.split()), statement + text]
        quoted = text.replace("'", "\u2019").replace(' "', " \u201c").replace('"', "\u201d").replace(", ", ",\u00a0").replace("\n", "\r\n")
        for form in [*forms, quoted, text.upper(), text.replace("license", "licence")]:
            want[len(docs)] = name
            docs.append((len(docs), form))
    more = len(docs)
    docs += [(more, LICENSES[0][1] + "\nand more"), (more + 1, LICENSES[1][1].replace("notice", "remark")), (None, LICENSES[0][1]), (more + 2, "x " * 500_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS license_id", "2 AS n_notices", "'t' AS text_digest", "0 AS lines", "0 AS named")
    rows = scan_licenses(df).collect()
    found = {r["doc_id"]: r["license_id"] for r in rows}
    assert len(rows) == len(docs) and {k: found[k] for k in want} == want
    assert found[more] is None and found[more + 1] is None and found[None] == "MIT" and found[more + 2] is None
    again = scan_licenses(df.unionByName(df)).collect()
    assert sorted(map(tuple, again), key=str) == sorted([*map(tuple, rows), *map(tuple, rows)], key=str)


SYSTEM = Path("/usr/share/common-licenses")
FILES = {"Artistic-1.0-Perl": "Artistic", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}


@pytest.mark.skipif(not (SYSTEM / "GPL-3").exists(), reason="the texts come with some systems only")
def test_digests_of_longer_licenses(spark):
    docs = [(k, (SYSTEM / FILES.get(name, name)).read_text("utf-8", "replace").replace("\n", "  \r\n")) for k, (name, _) in enumerate(DIGESTS)]
    rows = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license_id"] for r in rows] == [name for name, _ in DIGESTS]
