"""Drop lines that many documents share.

Lines are normalised (white space stripped at both ends, A-Z lower-cased),
hashed, counted once a document, and those in ``min_docs`` documents or more are
dropped everywhere; what stays is put together again by position.

A line's key is 16 bytes of BLAKE2b: lines of one key are one line, also among
10**14 of them.  Only keys are shuffled: each batch of documents sends one count
a distinct key, so a line that every document has costs one row a batch.  The
keys over the threshold are then either sent to all tasks, if there are at most
``broadcast_keys`` of them (16 bytes each), or joined to the lines' positions.

Defined results: a row is a document, so repeated rows count separately; a null
or empty text is one empty line; a key with no character is never dropped; a
text whose lines all go becomes empty; other columns pass, but for columns named
like an output (``n_lines``, ``n_dropped``), which are replaced; an empty table
gives an empty table; very long texts and lines are handled like others.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

#: Most keys sent to every task: 16 MB.
BROADCAST_KEYS = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"
#: Short lines whose keys a batch remembers.
REMEMBERED, SHORT = 1 << 16, 256


class Keys:
    """Keys of lines; that of a blank line is None."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def of(self, text: bytes) -> list[bytes | None]:
        known, out = self.known, []
        for line in text.split(b"\n"):
            line = line.strip(SPACE)
            key = known.get(line)
            if key is None and line:
                key = hashlib.blake2b(line.lower(), digest_size=16).digest()
                if len(line) <= SHORT and len(known) < REMEMBERED:
                    known[line] = key
            out.append(key)
        return out


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column, one at a time; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = Keys()
    for batch in batches:
        found: Counter[bytes] = Counter()
        for text in _bytes(batch.column(0)):
            found.update(set(keys.of(text)) - {None})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["line_key", "n_docs"])


def frequent_lines(df: DataFrame, text: str = "text", min_docs: int = 10) -> DataFrame:
    """line_key, n_docs of the keys found in ``min_docs`` documents or more."""
    counted = df.select(F.col(text).cast("string")).mapInArrow(_count, "line_key binary, n_docs long")
    return counted.groupBy("line_key").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _replaced(batch: pa.RecordBatch, at: int, gone: Callable[[int, bytes], list[bool]], leave: int = 0) -> pa.RecordBatch:
    """The batch without the lines that ``gone(row, text)`` marks, and the line counts; the last ``leave`` columns go."""
    texts, n_lines, n_dropped = [], [], []
    for row, text in enumerate(_bytes(batch.column(at))):
        marks = gone(row, text)
        dropped = sum(marks)
        if dropped:
            text = b"\n".join(line for line, mark in zip(text.split(b"\n"), marks, strict=True) if not mark)
        texts.append(text), n_lines.append(len(marks)), n_dropped.append(dropped)
    text = pa.array(texts, pa.binary()).cast(pa.string())
    columns = [text if k == at else batch.column(k) for k in range(batch.num_columns - leave)]
    names = batch.schema.names[: len(columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def drop_frequent_lines(df: DataFrame, text: str = "text", min_docs: int = 10, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` with the frequent lines gone from ``text``; adds n_lines, n_dropped."""
    spark = df.sparkSession
    df = df.select([F.col(f"`{c}`") if c != text else F.col(f"`{c}`").cast("string") for c in df.columns if c not in ("n_lines", "n_dropped")])
    at = df.columns.index(text)
    frequent = stored(frequent_lines(df, text, min_docs).select("line_key"))
    out = T.StructType([*df.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    if frequent.limit(broadcast_keys + 1).count() <= broadcast_keys:
        shared = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.toLocalIterator()))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, keys = shared.value, Keys()
            for batch in batches:
                yield _replaced(batch, at, lambda _, text: [key in known for key in keys.of(text)])

        return df.mapInArrow(listed, out)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for batch in batches:
            seen: set[bytes] = set()  # equal texts of a batch once
            for text, name in zip(_bytes(batch.column(0)), batch.column(1), strict=True):
                row = name.as_py()
                if row not in seen:
                    seen.add(row)
                    full = [(k, key) for k, key in enumerate(keys.of(text)) if key]
                    yield pa.RecordBatch.from_arrays([pa.array([key for _, key in full], pa.binary()), pa.array([row] * len(full), pa.binary()), pa.array([k for k, _ in full], pa.int64())], ["line_key", "_row", "_line"])

    # Rows with equal texts lose equal lines: the text's digest is the row's name here.
    named = df.withColumn("_row", F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    lines = named.select(text, "_row").mapInArrow(positions, "line_key binary, _row binary, _line long").join(frequent, "line_key", "left_semi")
    dropped = lines.groupBy("_row").agg(F.array_sort(F.collect_set("_line")).alias("_drop"))
    joined = named.join(dropped, "_row", "left").select(*df.columns, "_drop")

    def by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(batch.num_columns - 1)

            def gone(row: int, text: bytes) -> list[bool]:
                marks = [False] * (text.count(b"\n") + 1)
                for k in drops[row].as_py() or ():
                    marks[k] = True
                return marks

            yield _replaced(batch, at, gone, leave=1)

    return joined.mapInArrow(by_position, out)
