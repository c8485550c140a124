"""Which windows of a text also start earlier, over all documents of a table.

Shared by the two substring operators, whose symbols are words or bytes.  The
whole table's windows of W symbols are far too many to move, so they are grouped
by a prefix that equal windows must share: the smallest hash of the runs of k
symbols within a window.  Neighbouring windows mostly have the same one; each
stretch of them is one *slice* of text, and only its numbers are shuffled.

0.  common keys: those that a sample of documents has often.  Their windows get the
    longest prefix, all W symbols, as key from the start, so that no task meets all
    slices of a common passage; which keys these are changes no result.
1.  anchors: (key, hash of the slice, document, position) of every slice.  A batch
    sends one slice of each content on; the batch's later ones are found already.
2.  by key: later slices of equal content are found; if a key has slices of several
    contents, the first of each is asked for its text.  A key with over ``most``
    contents is *hot*, too: its windows get the longest prefix.
3.  by document: the texts of the slices asked for.  Windows of hot keys go as
    hashes, a batch sending one of each on.
4.  by key: memory-sized groups, handed to the operator's own method (subtrees or
    sorted suffixes); groups of hot windows are equal windows.
5.  by document: all stretches found, as one list.

Every step is a shuffle of a deterministic table, so lost executors cost a
recomputation only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Polynomial, Powers, Rolling, Words, expand, flat, mix, pieces, sliding_min, union_spans
from .shared import partitions, row_id

#: Contents of one key that are compared in one group.
MOST = 512
#: One document in so many is looked at for common keys; how often those come there at least; how many are told to tasks.
SAMPLE, OFTEN, TOLD = 64, 8, 100_000
#: Slices a batch sorts at once.
SORTED = 1 << 17
#: Longest stretch of windows in one slice.
LONGEST = 1 << 20
#: Kinds of rows: a stretch found; a slice, or one that can repeat within itself; a hot slice or window.
FOUND, ASKED, HOT, LOOPS = 0, 1, 2, 3

#: groups -> found: (data, slice offsets, group of each slice, documents) to (slice, start, end).
Method = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Rule:
    words: bool
    window: int
    gram: int
    #: Whether an earlier start in the same document counts.
    within: bool


class Symbols:
    """Symbol hashes of several documents: words or bytes."""

    def __init__(self, rule: Rule, data: np.ndarray, offsets: np.ndarray, tables: Powers):
        self.words = Words(data, offsets) if rule.words else None
        self.offsets = self.words.offsets if self.words else offsets
        self.values = self.words.hashes(tables=tables) if self.words else data
        self.tables = tables

    @cached_property
    def poly(self) -> Polynomial:
        """Tells stretches apart."""
        return Polynomial(self.values, self.tables)

    @cached_property
    def rolling(self) -> Rolling:
        """Chooses the keys."""
        return Rolling(self.values, self.tables)

    def bytes_of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.words.start[start], self.words.end[end - 1]) if self.words else (start, end)


def pack_place(start: np.ndarray, n: np.ndarray, kind) -> np.ndarray:
    """Start, symbols (under 2**21) and kind of a slice in one number that sorts by start."""
    return (np.asarray(start, np.int64) << 23) | (np.asarray(n, np.int64) << 2) | kind


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 23, (place >> 2) & ((1 << 21) - 1), place & 3


def _loops(grams: np.ndarray, least: np.ndarray, width: int, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which slices [start, end) of grams have their key twice or more."""
    # A gram is the least of a window around it if it is the largest of those windows' minima.
    edge = np.zeros(width - 1, U64)
    top = ~sliding_min(~np.concatenate([edge, least, edge]), width)
    at = np.flatnonzero(grams == top)
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    of = np.repeat(np.arange(len(key)), b - a)
    return np.bincount(of, weights=grams[at[expand(a, b - a)]] == key[of], minlength=len(key)) > 1


def _slices(rule: Rule, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first symbol, end and kind of each slice."""
    offsets, n = symbols.offsets, int(symbols.offsets[-1])
    if n < rule.window:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, width = symbols.rolling.grams(rule.gram), rule.window - rule.gram + 1
    least = sliding_min(grams, width)
    inside = np.ones(len(least), bool)
    first = np.maximum(offsets[1:-1] - rule.window + 1, np.maximum(offsets[:-2], 0))
    inside[expand(first, np.clip(np.minimum(offsets[1:-1], len(least)) - first, 0, None))] = False
    # A short document's windows all lie across its end.
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])])
    last = np.r_[new[1:], len(least)]
    new, last = new[inside[new]], last[inside[new]]
    if len(new) and int((last - new).max()) > LONGEST:
        parts = -(-(last - new) // LONGEST)
        starts = np.repeat(new, parts) + LONGEST * expand(np.zeros(len(parts), np.int64), parts)
        new, last = starts, np.minimum(starts + LONGEST, np.repeat(last, parts))
    key, end = least[new], last - 1 + rule.window
    kind = np.full(len(key), ASKED)
    if rule.within:
        kind[_loops(grams, least, width, key, new, end - rule.gram + 1)] = LOOPS
    return key, new, end, kind


def _found_spans(d: np.ndarray, t: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of stretches of each document: d, t, start, symbols (in parts a place can hold)."""
    if not len(d):
        return d, t, start, n
    order = np.lexsort((start, t, d))
    d, t, start, end = d[order], t[order], start[order], (start + n)[order]
    doc = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    wide = int(end.max()) + 2  # documents side by side
    a, b = union_spans(start + doc * wide, end + doc * wide)
    which = a // wide
    head = np.searchsorted(doc, which)
    parts = -(-(b - a) // LONGEST)
    starts = np.repeat(a, parts) + LONGEST * expand(np.zeros(len(parts), np.int64), parts)
    ends = np.minimum(starts + LONGEST, np.repeat(b, parts))
    which, head = np.repeat(which, parts), np.repeat(head, parts)
    return d[head], t[head], starts - which * wide, ends - starts


def _later(rule: Rule, new: np.ndarray, d: np.ndarray, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In sorted rows with ``new`` at the first of each class: found rows, and rows to keep."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = (d == d[first]) & (t == t[first]) & (start == start[first])
    if rule.within:
        return ~same, new
    found = d > d[first]
    return found, ~found & (new | ~same)


SENT = "key long, content long, d long, t long, place long"


def _rows(key: np.ndarray, content: np.ndarray, d: np.ndarray, t: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    columns = [x.view(np.int64) if x.dtype == U64 else x for x in (key, content, d, t, place)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "content", "d", "t", "place"])


def _spread(d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys of stretches already found: any, so that they lie evenly."""
    return mix(d.view(U64) ^ mix(start.astype(np.int64).view(U64) + U64(1)))


def _keys(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's keys, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in pieces(offsets):
                symbols = Symbols(rule, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                key, start, _, _ = _slices(rule, symbols)
                pairs = np.unique(np.stack([np.searchsorted(symbols.offsets, start, "right").astype(U64), key]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["key"])

    return run


def common_keys(rows: DataFrame, rule: Rule, text: str) -> np.ndarray:
    """At most TOLD keys that the sampled documents have most often, sorted."""
    sample = rows.where(F.pmod(F.xxhash64("d", "t"), F.lit(SAMPLE)) == 0).select(text)
    counts = sample.mapInArrow(_keys(rule), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "key").limit(TOLD).toPandas()["key"]
    return np.sort(np.asarray(found, dtype=np.int64).view(U64))


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _collapsed(rule: Rule, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One slice of each content, and the stretches of the others."""
    if not parts:
        return
    key, content, d, t, start, n, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, t, d, content, key))
    key, content, d, t, start, n, kind = (x[order] for x in (key, content, d, t, start, n, kind))
    new = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])] if len(key) else np.zeros(0, bool)
    found, keep = _later(rule, new, d, t, start)
    yield _rows(key[keep], content[keep], d[keep], t[keep], pack_place(start[keep], n[keep], kind[keep]))
    fd, ft, fs, fn = _found_spans(d[found], t[found], start[found], n[found])
    yield _rows(_spread(fd, fs), np.zeros(len(fd), np.int64), fd, ft, pack_place(fs, fn, FOUND))


def _anchors(rule: Rule, shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, common = Powers(), shared.value
        for batch in batches:
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = flat(batch.column(2))
            parts = []
            for i, j in pieces(offsets):
                if offsets[j] - offsets[i] < rule.window:
                    continue
                symbols = Symbols(rule, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                key, start, end, kind = _slices(rule, symbols)
                content = symbols.poly.spans(start, end)
                often = _is_in(key, common)
                if often.any():  # their windows, one by one
                    many = (end - start)[often] - rule.window + 1
                    at = expand(start[often], many)
                    own = np.repeat(key[often], many)
                    rest = ~often
                    whole = symbols.poly.spans(at, at + rule.window)
                    key = np.r_[key[rest], mix(own ^ whole)]
                    content = np.r_[content[rest], whole]
                    start, end, kind = np.r_[start[rest], at], np.r_[end[rest], at + rule.window], np.r_[kind[rest], np.full(len(at), ASKED)]
                doc = np.searchsorted(symbols.offsets, start, "right") - 1
                parts.append((key, content, ids[i:j][doc], marks[i:j][doc], start - symbols.offsets[doc], end - start, kind))
                if sum(len(p[0]) for p in parts) >= SORTED:
                    yield from _collapsed(rule, parts)
                    parts = []
            yield from _collapsed(rule, parts)

    return run


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names]


def _by_content(rule: Rule, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by key, content, document: what is found, and what to ask for."""

    names = ("key", "content", "d", "t", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        hot = False  # whether the held key is, so that what is held was sent
        for batch in _and_end(batches):
            last = batch is None
            rows = held if last else [np.concatenate(x) for x in zip(held, _columns(batch, names), strict=True)]
            if not len(rows[0]):
                continue
            key, content, d, t, place = rows
            start, n, kind = unpack_place(place)
            passing = kind == FOUND
            n_held = len(held[0])
            out = []
            if passing.any():
                out.append((key[passing], d[passing], t[passing], place[passing]))
            idx = np.flatnonzero(~passing)
            sent = idx < (n_held if hot else 0)
            key, content, d, t, start, n, kind = (x[idx] for x in (key, content, d, t, start, n, kind))
            if len(key):
                new = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])]
                found, keep = _later(rule, new, d, t, start)
                fd, ft, fs, fn = _found_spans(d[found], t[found], start[found], n[found])
                out.append((_spread(fd, fs).view(np.int64), fd, ft, pack_place(fs, fn, FOUND)))
                head = np.r_[True, key[1:] != key[:-1]]
                of = np.cumsum(head) - 1
                contents = np.bincount(of, weights=new).astype(np.int64)
                is_hot = contents > most
                is_hot[0] |= hot and bool(sent[:1].any())
                ask = keep & ~sent & ((contents[of] > 1) | is_hot[of] | (kind == LOOPS))
                open_key = of == of[-1]
                if not last:
                    ask &= ~open_key | is_hot[-1]
                kinds = np.where(is_hot[of], HOT, ASKED)
                out.append((key[ask], d[ask], t[ask], pack_place(start[ask], n[ask], kinds[ask])))
                if not last:
                    hot = bool(is_hot[-1])
                    hold = np.flatnonzero(keep & open_key)
                    if hot:  # the newest content's first row is enough
                        hold = np.flatnonzero(new & open_key)[-1:]
                    held = [key[hold], content[hold], d[hold], t[hold], pack_place(start[hold], n[hold], kind[hold])]
            for k, a, b, p in out:
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, a, b, p)], ["key", "d", "t", "place"])

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _texts(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document with a list of asked (place, key): slices, hot windows, found stretches."""

    names = ["key", "d", "t", "place", "slice"]

    def table(key: np.ndarray, d: np.ndarray, t: np.ndarray, place: np.ndarray, data: np.ndarray | None = None, offsets: np.ndarray | None = None) -> pa.RecordBatch:
        texts = pa.nulls(len(d), pa.binary()) if data is None else pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64) if x.dtype == U64 else x, pa.int64()) for x in (key, d, t, place)), texts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = flat(batch.column(2))
            lists = batch.column(3)
            list_offsets = np.asarray(lists.offsets).astype(np.int64)
            values = lists.values
            place, keys = np.asarray(values.field(0)), np.asarray(values.field(1))
            spans = [[], [], [], []]
            for i, j in pieces(offsets):
                a, b = list_offsets[i], list_offsets[j]
                doc = np.repeat(np.arange(j - i), np.diff(list_offsets[i : j + 1]))
                start, n, kind = unpack_place(place[a:b])
                key, d, t = keys[a:b], ids[i:j][doc], marks[i:j][doc]
                pick = kind == FOUND
                for column, x in zip(spans, (d, t, start, n), strict=True):
                    column.append(x[pick])
                if pick.all():
                    continue
                symbols = Symbols(rule, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                begin = start + symbols.offsets[doc]
                pick = np.flatnonzero(kind == ASKED)
                if len(pick):
                    x, y = symbols.bytes_of(begin[pick], begin[pick] + n[pick])
                    own = data[offsets[i] : offsets[j]]
                    yield table(key[pick], d[pick], t[pick], pack_place(start[pick], n[pick], ASKED), own[expand(x, y - x)], np.r_[0, np.cumsum(y - x)])
                pick = np.flatnonzero(kind == HOT)
                if len(pick):
                    many = n[pick] - rule.window + 1
                    at, of = expand(begin[pick], many), np.repeat(pick, many)
                    wkey = mix(key[of].view(U64) ^ symbols.poly.spans(at, at + rule.window))
                    wd, wt, ws = d[of], t[of], at - symbols.offsets[doc[of]]
                    order = np.lexsort((ws, wt, wd, wkey))
                    wkey, wd, wt, ws = (x[order] for x in (wkey, wd, wt, ws))
                    new = np.r_[True, wkey[1:] != wkey[:-1]]
                    found, keep = _later(rule, new, wd, wt, ws)
                    yield table(wkey[keep], wd[keep], wt[keep], pack_place(ws[keep], np.full(int(keep.sum()), rule.window), HOT))
                    for column, x in zip(spans, (wd[found], wt[found], ws[found], np.full(int(found.sum()), rule.window)), strict=True):
                        column.append(x)
            d, t, start, n = _found_spans(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in spans))
            yield table(_spread(d, start), d, t, pack_place(start, n, FOUND))

    return run


def _in_groups(rule: Rule, method: Method) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by key, document, place: all stretches found."""

    block = 1 << 19

    def groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """Found stretches of whole groups of slices."""
        key, d, t, place = (np.asarray(rows.column(c), dtype=np.int64) for c in ("key", "d", "t", "place"))
        data, offsets = flat(rows.column("slice"))
        start = place >> 23
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(offsets[edges], offsets[edges[a]] + block, "right")) - 1)
            b = min(b, len(edges) - 1)
            i, j = edges[a], edges[b]
            group = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
            which, x, y = method(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], group, d[i:j])
            yield d[i:j][which], t[i:j][which], start[i:j][which] + x, y - x
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in _and_end(batches):
            spans: list[tuple[np.ndarray, ...]] = []
            if batch is not None:
                kind = np.asarray(batch.column("place")) & 3
                d, t = np.asarray(batch.column("d")), np.asarray(batch.column("t"))
                start, n, _ = unpack_place(np.asarray(batch.column("place")))
                pick = kind == FOUND
                spans.append((d[pick], t[pick], start[pick], n[pick]))
                pick = np.flatnonzero(kind == HOT)
                if len(pick):
                    rows = [np.asarray(batch.column("key"))[pick], d[pick], t[pick], start[pick]]
                    rows = rows if first is None else [np.r_[x, y] for x, y in zip(first, rows, strict=True)]
                    new = np.r_[True, rows[0][1:] != rows[0][:-1]]
                    found, _ = _later(rule, new, *rows[1:])
                    spans.append((rows[1][found], rows[2][found], rows[3][found], np.full(int(found.sum()), rule.window)))
                    first = [x[np.flatnonzero(new)[-1:]] for x in rows]
                asked = pa.Table.from_batches([batch]).filter(pa.array(kind == ASKED))
                held = asked if held is None else pa.concat_tables([held, asked])
            if held is not None and held.num_rows:
                key = np.asarray(held.column("key"))
                whole = held.num_rows
                if batch is not None:  # the last key may go on
                    changes = np.flatnonzero(key[1:] != key[:-1])
                    whole = int(changes[-1]) + 1 if len(changes) else 0
                if whole:
                    spans += groups(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole).combine_chunks()
            if spans:
                d, t, start, n = _found_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, t, pack_place(start, n, FOUND))], ["d", "t", "place"])

    return run


def identified(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``df`` with d (the id, null as the smallest) and t, which tells texts of one id apart."""
    ids = df.select(row_id(doc_id).alias("d"))
    repeated = bool(ids.groupBy("d").count().where("count > 1").head(1))
    rows = df.withColumn("d", row_id(doc_id))
    return rows.withColumn("t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeated else F.coalesce(F.pmod("d", F.lit(1).cast("long")), F.lit(0).cast("long")))  # never null, so that equal scans stay equal plans


def repeated_stretches(rows: DataFrame, rule: Rule, method: Method, text: str = "text", most: int = MOST) -> DataFrame:
    """d, t, places: of each document with any, the stretches whose windows start earlier.

    ``rows`` has d, t and the text; ``method`` finds them within groups of slices.
    """
    n = partitions(rows.sparkSession)
    own = rows.select("d", "t", text)
    shared = rows.sparkSession.sparkContext.broadcast(common_keys(rows, rule, text))
    sent = own.mapInArrow(_anchors(rule, shared), SENT)
    by_key = sent.repartition(n, "key").sortWithinPartitions("key", "content", "d", "t", "place")
    asked = by_key.mapInArrow(_by_content(rule, most), "key long, d long, t long, place long")
    lists = asked.groupBy("d", "t").agg(F.collect_list(F.struct("place", "key")).alias("asked"))
    slices = own.join(lists, ["d", "t"]).mapInArrow(_texts(rule), "key long, d long, t long, place long, slice binary")
    grouped = slices.repartition(n, "key").sortWithinPartitions("key", "d", "t", "place")
    found = grouped.mapInArrow(_in_groups(rule, method), "d long, t long, place long")
    return found.groupBy("d", "t").agg(F.collect_list("place").alias("places"))


def removed_mask(n: int, places: list[int] | None) -> tuple[np.ndarray, int]:
    """Which of n symbols the places cover, and in how many maximal runs."""
    mask = np.zeros(n, bool)
    if not places:
        return mask, 0
    start, count, _ = unpack_place(np.asarray(places, np.int64))
    a, b = union_spans(start, start + count)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        mask[x:y] = True
    return mask, len(a)
