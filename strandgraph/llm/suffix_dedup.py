"""Remove byte passages that start earlier too, by deep-shallow suffix sorting.

Within a group of slices (``repeats`` makes them) all suffixes that begin a
window are sorted.  Multikey quicksort, with 8 bytes as one character and numpy
doing all groups' partitions at a depth at once, goes down to a shallow depth and
leaves those groups of suffixes that agree so far.  These go, in order of
document and position, into blind tries: a trie keeps branching depths and one
character an edge only, so that a search compares the suffix with one leaf.  A
suffix that agrees with a leaf over a whole window starts earlier too; both are
compared on to their ends, and the windows passed that way need no insertion.

Defined results: null text is empty; a text shorter than a window keeps all its
bytes; matches within one document count, overlapping ones too; rows with one id
and equal texts are one document; rows with one id and different texts come in
order of their texts' hashes; a null id is smaller than all others; other columns
pass, but for columns named like an output (kept, n_bytes, n_removed, n_spans);
an empty table gives none.  What is kept can split characters: it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import expand, flat, pieces
from .repeats import MOST, Rule, identified, removed_mask, repeated_stretches

WINDOW, GRAM, SHALLOW = 100, 40, 64


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    odd = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (odd.bit_length() + 7) // 8


class BlindTries:
    """One blind trie for each group of suffixes of ``text``, compared over ``window`` bytes."""

    def __init__(self, text: bytes, window: int):
        self.text, self.window = text, window
        self.roots: dict[int, int | list] = {}

    def insert(self, group: int, at: int) -> int | None:
        """The earlier suffix that agrees over the window, or None after insertion."""
        text, roots = self.text, self.roots
        node = roots.get(group)
        if node is None:
            roots[group] = at
            return None
        while type(node) is list:
            node = node[1].get(text[at + node[0]], node[2])
        leaf = node
        while type(leaf) is list:
            leaf = leaf[2]
        mine = text[at : at + self.window]
        depth = common(mine, text[leaf : leaf + self.window])
        if depth == self.window:
            return leaf
        above, node = None, roots[group]
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][mine[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][mine[depth]] = at
            return None
        branch = [depth, {text[leaf + depth]: node, mine[depth]: at}, node]
        if above is None:
            roots[group] = branch
        else:
            above[1][mine[above[0]]] = branch
            if above[2] is node:
                above[2] = branch
        return None


def shallow_groups(data: np.ndarray, at: np.ndarray, of: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that agree with another of their group down to ``depth``: at, of, group."""
    padded = np.append(data, np.zeros(8, np.uint8))
    for down in range(0, depth, 8):
        if not len(at):
            break
        letters = np.ascontiguousarray(padded[(at + down)[:, None] + np.arange(8)]).view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((letters, group))
        at, of, group, letters = at[order], of[order], group[order], letters[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (letters[1:] != letters[:-1])]
        group = np.cumsum(new) - 1
        more = np.bincount(group)[group] > 1
        at, of, group = at[more], of[more], group[more]
    return at, of, group


def deep_shallow(window: int, shallow: int = SHALLOW):
    """The method of a group: spans of windows that start earlier too."""
    shallow = shallow if shallow <= window else window // 8 * 8

    def method(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.maximum(np.diff(offsets) - window + 1, 0)
        at, of = expand(offsets[:-1], count), np.repeat(np.arange(len(count)), count)
        at, of, tied = shallow_groups(data, at, of, group[of], shallow)
        order = np.argsort(at)
        text, tries = data.tobytes(), BlindTries(data.tobytes(), window)
        ends, slices = offsets[1:].tolist(), np.searchsorted(offsets, at[order], "right") - 1
        found: list[tuple[int, int, int]] = []
        passed = -1
        for x, s, g in zip(at[order].tolist(), slices.tolist(), tied[order].tolist(), strict=True):
            if x < passed:
                continue
            y = tries.insert(g, x)
            if y is not None:
                end = ends[int(np.searchsorted(offsets, y, "right")) - 1]
                reach = window + common(text[x + window : ends[s]], text[y + window : end])
                found.append((s, x, x + reach))
                passed = x + reach - window + 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        s, a, b = (np.asarray(c) for c in zip(*found, strict=True))
        return s, a - offsets[s], b - offsets[s]

    return method


def dedup_suffixes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``df`` with kept (binary) for its text; adds n_bytes, n_removed, n_spans."""
    df = df.drop("kept", "n_bytes", "n_removed", "n_spans")
    rule = Rule(words=False, window=window, gram=min(gram, window), within=True)
    rows = identified(df.withColumn(text, F.col(text).cast("string")), text, doc_id)
    found = repeated_stretches(rows, rule, deep_shallow(window), text, most)
    only = set(df.columns) == {doc_id, text} and df.schema[doc_id].dataType.simpleString() == "bigint"
    if only:  # the id can be had from d: then the texts are shuffled once for both joins
        joined = rows.select("d", "t", text).join(found, ["d", "t"], "left").withColumn(doc_id, F.when(F.col("d") != F.lit(-(2**63)), F.col("d")))
    else:
        joined = rows.join(found, ["d", "t"], "left")
    joined = joined.select(*(c for c in df.columns if c != text), text, "places")
    others = [c for c in df.columns if c != text]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(len(others)))
            places = batch.column(len(others) + 1).to_pylist()
            texts, numbers = [], []
            for i, j in pieces(offsets):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                keep = np.ones(len(own), bool)
                spans = np.zeros(j - i, np.int64)
                for k in range(i, j):
                    if places[k]:
                        mask, spans[k - i] = removed_mask(int(off[k - i + 1] - off[k - i]), places[k])
                        keep[off[k - i] : off[k - i + 1]] = ~mask
                counted = np.r_[0, np.cumsum(keep)][off]
                texts.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(counted.astype(np.int32)), pa.py_buffer(own[keep])]))
                numbers.append((np.diff(off), np.diff(off) - np.diff(counted), spans))
            texts = pa.concat_arrays(texts) if texts else pa.array([], pa.binary())
            columns = [np.concatenate(x) for x in zip(*numbers, strict=True)] if numbers else [np.zeros(0, np.int64)] * 3
            arrays = [*batch.columns[: len(others)], texts, *(pa.array(x, pa.int64()) for x in columns)]
            yield pa.RecordBatch.from_arrays(arrays, [*others, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = joined.drop(text, "places").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return joined.mapInArrow(kept, schema)
