"""Pack token sequences into windows of fixed length by minimum bin slack.

A document's ids are cut into full windows and one rest.  The rests are packed:
from the counts of rests by length, bit-set subset sums pick the multiset of
lengths that fills what is left of a window closest to its capacity; the picks
are found by going back through the bit sets, and a found pattern is used as
often as the counts allow.  The counts have one entry a length at most, so this
takes the same short time for any number of documents and loses none of them.

Which document goes where follows from its place among the pieces of its length:
a pattern's copies take consecutive places.  Places come from counts by (length,
slice of the ids), so that no length is sorted as a whole in one task.

Defined results: a null text is empty and has only the closing id; repeated rows
are packed separately; a table without rows gives none; a document longer than a
window is cut every ``window`` ids; extra columns are left out, so none can clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import back_to_id, row_id, stored

WINDOW = 1024
#: Slices of the pieces of one length at least, and pieces a slice has at most on average.
SLICES, PER_SLICE = 64, 200_000
#: White space in a row on which the quick splitter, which keeps a mark a character, is not relied on.
LONG_RUN = 1000
#: Fixed value: how byte-level pre-tokenizers split text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TWO = re.compile(r"\s\s")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a ``tokenizers`` file, without special tokens added.

    A plain byte-level BPE file whose ids are its merge ranks gives the same ids
    through tiktoken, in a fifth of the time; any other file, and any text with a
    long run of white space, goes through ``tokenizers`` itself.
    """
    import tokenizers

    def whole(text: str) -> list[int]:
        return tokenizer().encode(text, add_special_tokens=False).ids

    @cache
    def tokenizer() -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(path)

    spec = json.load(open(path, encoding="utf-8"))
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    vocab = model.get("vocab") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    own = {t["content"] for t in added}
    plain = (
        model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges") and not spec.get("normalizer")
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        and all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added) and all(len(t) == 1 for t in sorted(set(vocab) - own, key=vocab.get)[:256])
        and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    )
    if not plain:
        return whole
    import tiktoken

    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in own}
    special = {t["content"]: t["id"] for t in added}
    made = tiktoken.Encoding("from_file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    run = re.compile(rf"\s{{{LONG_RUN}}}")
    step = LONG_RUN // 2  # a long run has two samples in a row

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and TWO.search(text[::step]) and run.search(text):
            return whole(text)
        return made.encode(text, allowed_special="all") if any(s in text for s in special) else made.encode_ordinary(text)

    return encode


def cut(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, closing: int = 0) -> DataFrame:
    """_id, start, length, ids_crc32, doc_tokens: full windows, then the rest."""
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, value in zip(ids_of, batch.column(1), strict=True):
                ids = np.asarray([*encode(value.as_py() or ""), closing], dtype="<u4")
                raw = ids.tobytes()
                for start in range(0, len(ids), window):
                    n = min(window, len(ids) - start)
                    for column, x in zip(out, (row, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return df.select(row_id(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to capacity from below."""
    limit = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        most, size = min(counts[length], capacity // length), 1
        while most:  # counts in binary parts: 1, 2, 4, ..., rest
            part = min(size, most)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & limit
            most, size = most - part, size * 2
        if reach >> capacity & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:  # only with this part can the sum be reached
            picked[length] = picked.get(length, 0) + part
            at -= length * part
    return picked


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) that use up the counts."""
    left, found = {k: n for k, n in counts.items() if n}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        rest = fill(left, window - largest)
        left[largest] += 1
        rest[largest] = rest.get(largest, 0) + 1
        times = min(left[k] // n for k, n in rest.items())
        for k, n in rest.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        found.append((times, sorted(rest.items(), reverse=True)))
    return found


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first place, places, copies in a sequence, first sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in found:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, times * copies, copies, sequence, offset))
            used[length] = first + times * copies
            offset += length * copies
        sequence += times
    return out


def pack(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, closing: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row a piece."""
    spark = df.sparkSession
    cuts = stored(cut(df, path, text, doc_id, window, closing))
    lengths = {int(r["length"]): int(r["n"]) for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    slices = max(SLICES, -(-sum(lengths.values()) // PER_SLICE))
    cuts = cuts.withColumn("_slice", F.pmod(F.xxhash64("_id", "start", "ids_crc32"), F.lit(slices)))

    table = [(k, [tuple(x) for x in v]) for k, v in places(patterns(lengths, window)).items()]
    by_length = spark.createDataFrame(table, "length long, _runs array<struct<first: long, n: long, copies: long, sequence: long, offset: long>>")

    counts = cuts.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_id", "start", "ids_crc32")) - 1
    placed = cuts.withColumn("_own", own).join(starts, ["length", "_slice"]).withColumn("_place", F.col("_first") + F.col("_own"))
    run = F.filter("_runs", lambda r: (F.col("_place") >= r["first"]) & (F.col("_place") < r["first"] + r["n"]))[0]
    placed = placed.join(F.broadcast(by_length), "length").withColumn("_run", run)  # window rows at most
    within = F.col("_place") - F.col("_run.first")
    return placed.select(
        back_to_id("_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_run.sequence") + F.floor(within / F.col("_run.copies"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + within % F.col("_run.copies") * F.col("length")).cast("long").alias("offset"),
    )
