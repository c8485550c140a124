"""Remove word passages that smaller documents have too, by prefix-partitioned suffix trees.

Suffixes of all texts are split by prefixes of variable length into groups that
fit in memory: first by a prefix of GRAM words, and by the longest one, a whole
window, where a group would be too large (``repeats`` tells how).  Over each
group a suffix tree is built from the top down: a node's suffixes are split by
the words of the next edge, and nodes whose suffixes are of one document are cut
off.  What is left at the depth of a window are the deep internal nodes; their
suffixes are the repeats, and neighbouring ones join to maximal repeats.

Defined results: null text has no words; a text shorter than a window keeps all
its words; a repeat within one document alone is none; rows with one id are one
document's, so none of them removes from the other, and equal rows get equal
results; a null id is smaller than all others; very long texts are handled like
others, alone in their batch piece; other columns pass, but for columns named
like an output (n_words, n_removed, n_spans); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Polynomial, Words, expand, flat, pieces, text_array
from .repeats import MOST, Rule, identified, removed_mask, repeated_stretches

WINDOW, GRAM = 50, 12
#: Depths, in words, at which a subtree's nodes are split.
DEPTHS = (16, 24, 32, 40)


def subtrees(window: int):
    """The method of a group: spans of windows that smaller documents have too."""

    def method(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(data, offsets)
        poly = Polynomial(words.hashes())
        count = np.diff(words.offsets) - window + 1
        at = expand(words.offsets[:-1], np.maximum(count, 0))
        of = np.repeat(np.arange(len(count)), np.maximum(count, 0))
        node, depth = group[of], 0
        smallest = doc[of]
        for deeper in [x for x in DEPTHS if x < window] + [window]:
            if not len(at):
                break
            edge = poly.spans(at + depth, at + deeper)
            order = np.lexsort((doc[of], edge, node))
            at, of, node, edge = at[order], of[order], node[order], edge[order]
            new = np.r_[True, (node[1:] != node[:-1]) | (edge[1:] != edge[:-1])]
            head = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            tail = np.r_[head[1:], len(at)] - 1
            least, most = doc[of[head]], doc[of[tail]]  # sorted by document within a node
            inner = (least < most)[node]
            smallest = least[node][inner]
            at, of, node, depth = at[inner], of[inner], node[inner], deeper
        hit = doc[of] > smallest
        at, of = at[hit], of[hit]
        order = np.argsort(at)
        at, of = at[order] - words.offsets[of[order]], of[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
        last = np.r_[np.flatnonzero(new)[1:], len(at)] - 1 if len(at) else np.zeros(0, np.int64)
        return of[new], at[new], at[last] + window

    return method


def dedup_substrings(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``df`` with the kept words as text, joined by one space; adds n_words, n_removed, n_spans."""
    df = df.drop("n_words", "n_removed", "n_spans")
    rule = Rule(words=True, window=window, gram=min(gram, window), within=False)
    rows = identified(df.withColumn(text, F.col(text).cast("string")), text, doc_id)
    found = repeated_stretches(rows, rule, subtrees(window), text, most)
    only = set(df.columns) == {doc_id, text} and df.schema[doc_id].dataType.simpleString() == "bigint"
    if only:  # the id can be had from d: then the texts are shuffled once for both joins
        joined = rows.select("d", "t", text).join(found, ["d", "t"], "left").withColumn(doc_id, F.when(F.col("d") != F.lit(-(2**63)), F.col("d")))
    else:
        joined = rows.join(found, ["d", "t"], "left")
    joined = joined.select(*df.columns, "places")
    at = df.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            places = batch.column(batch.num_columns - 1).to_pylist()
            texts, numbers = [], []
            for i, j in pieces(offsets):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = Words(own, off)
                n_words = np.diff(words.offsets)
                keep = np.ones(len(words.start), bool)
                spans = np.zeros(j - i, np.int64)
                for k in range(i, j):
                    if places[k]:
                        mask, spans[k - i] = removed_mask(int(n_words[k - i]), places[k])
                        keep[words.offsets[k - i] : words.offsets[k - i + 1]] = ~mask
                counted = np.r_[0, np.cumsum(keep)][words.offsets]
                size = (words.end - words.start)[keep]
                step = size + 1
                last = counted[1:][np.diff(counted) > 0] - 1
                step[last] -= 1  # no space after a document's last word
                padded = np.append(own, np.uint8(32))
                out = padded[expand(words.start[keep], step)]
                ends = np.cumsum(step)
                gap = np.ones(len(step), bool)
                gap[last] = False
                out[ends[gap] - 1] = 32
                texts.append(text_array(out, np.r_[0, ends][counted]))
                numbers.append((n_words, n_words - np.diff(counted), spans))
            texts = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            columns = [np.concatenate(x) for x in zip(*numbers, strict=True)] if numbers else [np.zeros(0, np.int64)] * 3
            arrays = [texts if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in columns)], [*batch.schema.names[:-1], "n_words", "n_removed", "n_spans"])

    schema = joined.drop("places").schema.add("n_words", "long").add("n_removed", "long").add("n_spans", "long")
    return joined.mapInArrow(kept, schema)
