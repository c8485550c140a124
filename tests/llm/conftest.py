import pytest

#: Nulls, blanks, ties, repeats, long texts, odd characters, names that clash with outputs.
LINE = "The same old line that all of these documents have"


def odd_documents() -> list[tuple]:
    passage = " ".join(f"word{k}" for k in range(60))
    near = [f"shingle{k}" for k in range(120)]
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "ÜÖÄ ß é", "de", "b"), (5, "1234 !! %% 99", "en", "b"),
        (6, passage + " tail one", "en", "a"), (7, "head " + passage, "en", "a"), (8, "head " + passage, "en", "a"), (8, "head " + passage, "en", "a"),
        (9, "ab" * 4000, "fr", "c"), (10, ("lorem ipsum dolor sit amet " * 900).strip(), "fr", "c"), (11, "x", "es", None), (12, "x", "es", None),
        (13, " ".join(near), "en", "a"), (14, " ".join([*near[:60], "other", *near[61:]]), "en", "b"), (15, " ".join(near[:100]), "en", "b"),
        (None, "no id at all here", "en", "a"), (-5, "negative id <|endoftext|> inside", "en", "a"), (16, "MIT License\n\nCopyright (c) 1999 Someone", "en", "a"),
        (17, " non breaking space wide", "en", "b"), (18, "tab\tand\x0bvertical\x0cfeed\rreturn", "en", "b"), (19, "😀 emoji only 😀", "en", "b"),
    ]
    rows += [(100 + k, f"own text number {k}\n  {LINE if k % 2 else LINE.upper()} \n\nlast {k}", "en", "abc"[k % 3]) for k in range(14)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_lines int, n_words int, taken string, score string, d long, key string"
    return spark.createDataFrame([(*r, 7, 7, "x", "y", 1, "k") for r in odd_documents()], schema).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)
