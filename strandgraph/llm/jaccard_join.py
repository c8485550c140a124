"""Link documents whose n-gram sets have a high Jaccard similarity.

The counts come from a blocked sparse matrix product: rows are documents, columns
n-grams; blocks of some hundred rows are multiplied a block of columns at a time,
and a pair is discarded as soon as its count so far plus what is left to come
stays below the overlap that the two sizes ask for.

Which rows meet in a block:

1.  Equal sets are one row.
2.  Two sets of similarity t differ in at most (|x| + |y|)(1 - t)/(1 + t) elements.
    Split into one part more than that, by the elements' hashes, they agree in a
    part.  So rows with an equal part, and only those, are candidates; numbers of
    parts follow size classes, of which a set takes part in two.  Empty parts do not
    count (``part_keys`` tells how that loses nothing).
3.  Each row meets the first row of its part (a star); linked rows are joined to
    components.
4.  Rows that share a part with more than one component among them meet, those
    outside the largest all others, block by block.  Rows joined by candidate
    pairs are a family; where its parts have more pairs together than the family
    as a whole, the family meets instead.
5.  Sets are compared in two steps.  A set's sketch has a bit for about each
    element: whether an odd number of elements fall there.  Sketches differ in no
    more bits than the sets do in elements, so rows whose sketch is too far from
    all others of their block leave it, and only the others' sets are multiplied.

No block or task holds more than some hundred rows of a group (some hundred sets,
``WIDE`` times as many sketches), however large it is, and pairs are never emitted:
a block gives the links that join components.

Defined results: null or empty text has no n-gram and links with nothing; a text
with fewer words than n is one n-gram; letters A-Z count as a-z; repeated rows are
linked; ids may repeat, and a null id is smaller than all others; other columns
are left out; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, Polynomial, Powers, Words, expand, flat, mix, pieces, text_array
from .shared import back_to_id, few, partitions, row_id, stored, tidy

#: Rows of a block, and columns multiplied at once.
BLOCK, COLUMNS = 96, 4096
#: Sketches at once (in a block, in a turn) for each set at once, and the least and the most bits of a sketch.
WIDE, LEAST_BITS, MOST_BITS = 8, 256, 1 << 20
#: Ways to deal elements to parts, for sets that leave too many parts empty.
DEALINGS = 4
#: Most rows (an id each) sent to every task in place of a shuffle of all texts.
BROADCAST_ROWS = 1 << 20
#: Rows of families' blocks shuffled at once: so many, or so many times the sets if that is more.
AT_ONCE, SETS_AT_ONCE = 1 << 16, 2


def size_classes(percent: int, largest: int) -> np.ndarray:
    """First sizes of the classes: similar sets lie in one class or in neighbours."""
    first = [1]
    while first[-1] <= largest:
        first.append(first[-1] * 100 // percent + 1)
    for _ in range(2):
        first.append(first[-1] * 100 // percent + 1)
    return np.asarray(first, np.int64)


class Sets:
    """Distinct n-grams of several documents: values sorted within each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int, tables: Powers):
        words = Words(data, offsets)
        poly = Polynomial(words.hashes(lower=True, tables=tables), tables)
        count = np.diff(words.offsets)
        grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        at = expand(words.offsets[:-1], grams)
        doc = np.repeat(np.arange(len(count)), grams)
        value = poly.spans(at, at + np.minimum(n, count)[doc])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
        self.doc, self.value = doc[new], value[new]
        self.sizes = np.bincount(self.doc, minlength=len(count))
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        sums = np.r_[U64(0), np.cumsum(mix(self.value + U64(0x632BE59BD9B4E019)))]
        #: One number for each set.
        self.names = mix(sums[self.offsets[1:]] - sums[self.offsets[:-1]] + self.sizes.astype(U64))


def _batches(batch: pa.RecordBatch, at: int, n: int, tables: Powers) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = flat(batch.column(at))
    for i, j in pieces(offsets):
        yield i, j, Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, tables)


def _names(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            found = [(s.names, s.sizes) for _, _, s in _batches(batch, 1, n, tables)]
            names, sizes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.view(np.int64)), pa.array(sizes, pa.int64())], ["d", "s", "n"])

    return run


def spare_parts(differ: int, smallest: int) -> int:
    """Parts beyond ``differ + 1`` that make up for those a set of the smallest size leaves empty, by and large."""
    for spare in range(2 * differ + 8):
        parts = differ + 1 + spare
        empty = parts * np.exp(-smallest / parts)
        if empty + 2.5 * np.sqrt(empty) <= spare or empty < 1e-3:
            return spare
    return 2


def part_keys(sets: Sets, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of the chosen rows' sets, and the row of each.

    Empty parts would make strangers meet, so they have no key.  With some spare
    parts, similar sets still agree in a part with elements unless both leave more
    parts empty than there are spare ones; such sets get keys by another dealing of
    the elements, too, and at the last dealing by their empty parts as well.
    """
    first = size_classes(percent, int(sets.sizes.max(initial=1)))
    own = np.searchsorted(first, sets.sizes, "right") - 1
    differ_of = 2 * (first[1:] - 1) * (100 - percent) // (100 + percent)  # by class, for it and the one below
    spare_of = np.asarray([spare_parts(int(d), int(first[max(c - 1, 0)])) for c, d in enumerate(differ_of)])
    chosen = np.zeros(len(sets.sizes), bool)
    chosen[rows] = True
    keys, of = [], []
    for up in (0, 1):
        level = own + up
        use = chosen & (sets.sizes > 0) & (differ_of[level] > 0)  # else only equal sets are similar
        for dealing in range(DEALINGS):
            if not use.any():
                break
            parts = np.where(use, differ_of[level] + 1 + spare_of[level], 0)
            start = np.cumsum(parts) - parts
            mine = use[sets.doc]
            doc, value = sets.doc[mine], sets.value[mine]
            mixed = mix(value + (level[doc] * DEALINGS + dealing).astype(U64) * U64(0xA0761D6478BD642F))
            slot = start[doc] + ((mixed >> U64(32)) * parts[doc].astype(U64) >> U64(32)).astype(np.int64)
            total = np.zeros(int(parts.sum()), U64)
            np.add.at(total, slot, mix(mixed))
            full = np.bincount(slot, minlength=len(total)) > 0
            owner = np.repeat(np.arange(len(parts)), parts)
            empty = parts - np.bincount(owner[full], minlength=len(parts))
            use = use & (empty > spare_of[level])
            sent = np.flatnonzero(full | use[owner]) if dealing == DEALINGS - 1 else np.flatnonzero(full)
            number = sent - start[owner[sent]]
            keys.append(mix(total[sent] + mix(((level[owner[sent]] * DEALINGS + dealing).astype(U64) << U64(40)) + number.astype(U64))))
            of.append(owner[sent])
    return (np.concatenate(keys), np.concatenate(of)) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))


def _parts(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            seen: set[int] = set()  # equal sets of a batch once
            for _, _, sets in _batches(batch, 0, n, tables):
                _, once = np.unique(sets.names, return_index=True)
                fresh = np.asarray([k for k in once.tolist() if int(sets.names[k]) not in seen], dtype=np.int64)
                seen.update(sets.names[fresh].tolist())
                keys, of = part_keys(sets, fresh, percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets.names[of].view(np.int64))], ["key", "s"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and set: each set but the first of its key once, with that first set."""
    last: list[np.ndarray] | None = None
    for batch in batches:
        key, s = (np.asarray(batch.column(k)) for k in range(2))
        if not len(key):
            continue
        if last is not None:
            key, s = np.r_[last[0], key], np.r_[last[1], s]
        new = np.r_[True, key[1:] != key[:-1]]
        first = s[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if last is not None:
            first = np.where(key == key[0], last[2], first)
        pick = (s != first) & np.r_[last is None, (s[1:] != s[:-1]) | new[1:]]
        last = [key[-1:], s[-1:], first[-1:]]
        yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (key, first, s)], ["key", "c", "s"])


def overlaps(values: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left rows, of right rows) similar enough, by a product over blocks of columns."""
    sizes = np.diff(offsets)
    need = sizes[left][:, None] + sizes[right][None, :]
    alive = np.minimum(sizes[left][:, None], sizes[right][None, :]) * 100 >= percent * np.maximum(sizes[left][:, None], sizes[right][None, :])
    count = np.zeros(alive.shape, np.int64)
    columns, column = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    some = np.bincount(column) > 1  # a column of one row adds to no pair
    kept = np.flatnonzero(some[column])
    kept = kept[np.argsort(column[kept], kind="stable")]
    column, row = (np.cumsum(some) - 1)[column[kept]], row[kept]
    edges = np.searchsorted(column, np.arange(0, int(some.sum()) + COLUMNS, COLUMNS))
    left_to_come = np.bincount(row, minlength=len(sizes))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        block = np.zeros((len(sizes), COLUMNS), np.float32)
        block[row[a:b], column[a:b] % COLUMNS] = 1
        count += (block[left] @ block[right].T).astype(np.int64)
        left_to_come = left_to_come - np.bincount(row[a:b], minlength=len(sizes))
        best = count + np.minimum(left_to_come[left][:, None], left_to_come[right][None, :])
        alive &= best * (100 + percent) >= percent * need
        if not alive.any():
            break
    alive &= count * (100 + percent) >= percent * need
    return np.nonzero(alive)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, those that join what was apart."""
    parent, kept = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _product(percent: int):
    """Over rows sorted by group: links between different components.

    A row is a set with its component and its side: 0 meets all, 1 meets side 0 only.
    """

    def links(side: np.ndarray, s: np.ndarray, comp: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        left = np.flatnonzero(side == 0)
        if not len(left) or len(s) < 2 or (comp == comp[0]).all():
            return []
        x, y = overlaps(values, offsets, left, np.arange(len(s)), percent)
        x = left[x]
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        _, dense = np.unique(comp, return_inverse=True)
        firsts = {}
        for k, c in enumerate(dense.tolist()):
            firsts.setdefault(c, k)
        joined = _roots(len(firsts), dense[x], dense[y])
        where = {}
        for k, pair in enumerate(zip(dense[x].tolist(), dense[y].tolist(), strict=True)):
            where.setdefault(pair, k)
        return [(int(s[x[where[p]]]), int(s[y[where[p]]])) for p in joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, held, offsets, data in _groups(batches, "grams"):
            side, s, comp = (np.asarray(held.column(c)) for c in ("side", "s", "comp"))
            out = links(side, s, comp, data.view(np.uint64) if len(data) else np.zeros(0, U64), offsets // 8)
            if out:
                yield tuple(np.asarray(x, np.int64) for x in zip(*out, strict=True))

    return lambda batches: _batched(run(batches), {"a": pa.int64(), "b": pa.int64()})


def _batched(found: Iterator[tuple[np.ndarray, ...]], kinds: dict[str, pa.DataType], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The columns of many groups in few batches."""
    held, n = [], 0
    for columns in _and_end(found):
        if columns is not None:
            held.append(columns)
            n += len(columns[0])
        if held and (columns is None or n >= rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, n = [], 0


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            for _, _, sets in _batches(batch, 0, n, tables):
                raw = sets.value.view(np.uint8)
                off = pa.py_buffer((sets.offsets * 8).astype(np.int32))
                grams = pa.Array.from_buffers(pa.binary(), len(sets.sizes), [None, off, pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([pa.array(sets.names.view(np.int64)), grams], ["s", "grams"])

    return run


def sketch(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """For about each element of a set a bit, whether an odd number of elements fall there: bytes of all sets, and their offsets."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(sets.sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    ends = np.cumsum(bits)
    at = (ends - bits)[sets.doc] + (mix(sets.value) & (bits - 1)[sets.doc].astype(U64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(bool), bitorder="little"), np.r_[0, ends // 8]


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            for _, _, sets in _batches(batch, 0, n, tables):
                data, offsets = sketch(sets)
                yield pa.RecordBatch.from_arrays([pa.array(sets.names.view(np.int64)), pa.array(sets.sizes, pa.int64()), text_array(data, offsets, pa.binary())], ["s", "n", "sketch"])

    return run


def close_sketches(size: np.ndarray, data: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``left``, row of ``right``) that sizes and sketches allow to be similar; a longer sketch is folded to the shorter."""
    length = np.diff(offsets)
    out = [(left[:0], right[:0])]
    for long in np.unique(length).tolist():
        folded = {}
        for kind in np.unique(length[length >= long]).tolist():
            rows = np.flatnonzero(length == kind)
            words = data[expand(offsets[rows], length[rows])].view(U64).reshape(len(rows), kind // long, long // 8)
            folded[kind] = (rows, np.bitwise_xor.reduce(words, axis=1))
        for kind, (rows, words) in folded.items():
            for x_kind, y_kind in {(long, kind), (kind, long)}:
                xs, ys = (np.flatnonzero(np.isin(folded[k][0], side)) for k, side in ((x_kind, left), (y_kind, right)))
                x, y = folded[x_kind][0][xs], folded[y_kind][0][ys]
                if not len(x) or not len(y):
                    continue
                step = max(1, (1 << 20) // (len(y) * long))
                for a in range(0, len(x), step):
                    m, n = size[x[a : a + step]][:, None], size[y][None, :]
                    fits = np.minimum(m, n) * 100 >= percent * np.maximum(m, n)
                    if not fits.any():
                        continue
                    apart = np.bitwise_count(folded[x_kind][1][xs[a : a + step]][:, None, :] ^ folded[y_kind][1][ys][None, :, :]).sum(axis=2, dtype=np.int64)
                    p, q = np.nonzero(fits & (apart * (100 + percent) <= (100 - percent) * (m + n)))
                    out.append((x[a + p], y[q]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _near(percent: int, block: int):
    """Over rows sorted by group: those with a close sketch of another component, in blocks of at most ``block`` sets a side."""

    def rows(g: int, side: np.ndarray, s: np.ndarray, comp: np.ndarray, size: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        left = np.flatnonzero(side == 0)
        if not len(left) or len(s) < 2 or (comp == comp[0]).all():
            return
        x, y = close_sketches(size, data, offsets, left, np.arange(len(s)), percent)
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return
        place = [np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)]
        for k, z in enumerate((x, y)):  # close rows of a component side by side
            own = np.unique(z)
            place[k][own[np.argsort(comp[own], kind="stable")]] = np.arange(len(own)) // block
        i, j = place[0][x], place[1][y]
        order = np.lexsort((j, i))
        x, y, i, j = x[order], y[order], i[order], j[order]
        edges = np.r_[0, np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(i)]
        for number, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            near = np.unique(x[a:b])
            far = np.setdiff1d(y[a:b], near)
            both = np.r_[near, far]
            name = np.asarray([g], np.int64).view(U64)
            if number:
                name = mix(name + U64(number * 0x9E3779B97F4A7C15 % 2**64))
            yield np.repeat(name.view(np.int64), len(both)), np.repeat([0, 1], [len(near), len(far)]), s[both], comp[both]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g, held, offsets, data in _groups(batches, "sketch"):
            side, s, comp, size = (np.asarray(held.column(c)) for c in ("side", "s", "comp", "n"))
            yield from rows(g, side, s, comp, size, data, offsets)

    return lambda batches: _batched(run(batches), {"g": pa.int64(), "side": pa.int32(), "s": pa.int64(), "comp": pa.int64()})


def _groups(batches: Iterator[pa.RecordBatch], binary: str) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """Each group of rows sorted by ``g``: its number, its rows, and a binary column's offsets and bytes."""
    held: pa.Table | None = None
    for batch in _and_end(batches):
        if batch is not None:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
        if held is None or not held.num_rows:
            continue
        held = held.combine_chunks()
        group = np.asarray(held.column("g"))
        edges = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
        data, offsets = flat(held.column(binary))
        last = len(edges) - 1 if batch is None else len(edges) - 2
        for a, b in zip(edges[:last].tolist(), edges[1 : last + 1].tolist(), strict=True):
            yield int(group[a]), held.slice(a, b - a), offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        held = held.slice(int(edges[last]))


def _close(rows: DataFrame, sketches: DataFrame, percent: int, block: int) -> DataFrame:
    """Of rows (g, side, s, comp), stored, those whose sets have to be compared."""
    placed = rows.join(sketches, "s").select("g", "side", "s", "comp", "n", "sketch")
    ordered = placed.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "side", "s")
    return stored(ordered.mapInArrow(_near(percent, block), "g long, side int, s long, comp long"))


def _links(rows: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Links from rows (g, side, s, comp), their sets joined."""
    placed = rows.join(grams, "s").select("g", "side", "s", "comp", "grams")
    ordered = placed.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "side", "s")
    return stored(ordered.mapInArrow(_product(percent), "a long, b long"))


def _bounded(ids: DataFrame) -> DataFrame:
    """Stored ids, to be sent to every task if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def similar_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: a row a document."""
    texts = df.select(row_id(doc_id).alias("d"), F.col(text).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_names(n), "d long, s long, n long"))
    tidy(df.sparkSession)

    keys = texts.select("text").mapInArrow(_parts(n, percent), "key long, s long")
    by_key = keys.repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key", "s")
    members = stored(by_key.mapInArrow(_members, "key long, c long, s long"))
    tidy(df.sparkSession)  # the parts' shuffle is the largest
    stars = stored(members.select("c", "s").distinct())
    least = stored(rows.where("n > 0").groupBy("s").agg(F.min("d").alias("least")))
    found = None
    if n_stars := stars.count():
        small = lambda x: stored(few(x, n_stars))
        stars = few(stars, n_stars)
        nodes = small(stars.select("s").unionByName(stars.select(F.col("c").alias("s"))).distinct())

        def of_sets(s: DataFrame, made: str, run) -> DataFrame:  # noqa: ANN001
            """What ``run`` makes of the texts of these sets, a row a set."""
            ids = stored(few(least.join(s, "s").select(F.col("least").alias("d")).distinct(), n_stars))
            own = texts.join(F.broadcast(ids), "d", "left_semi") if ids.count() <= BROADCAST_ROWS else texts
            kinds = {"grams": "s long, grams binary", "sketch": "s long, n long, sketch binary"}[made]
            out = own.select("text").mapInArrow(run(n), kinds)
            out = out if own is not texts else out.join(s, "s", "left_semi")  # rather than a shuffle of all texts
            rest = [c for c in out.columns if c != "s"]
            out = stored(few(out.groupBy("s").agg(*(F.first(c).alias(c) for c in rest)), 100 * n_stars))
            tidy(df.sparkSession)
            return out

        def in_turns(rows: DataFrame, at_once: int) -> list[DataFrame]:  # large groups' blocks exceed the disks if all are there at once
            turns = max(1, -(-rows.count() // max(at_once, 1)))
            return [rows.where(F.pmod(F.xxhash64("g", F.lit(2)), F.lit(turns)) == turn) if turns > 1 else rows for turn in range(turns)]

        def together(tables: Iterator[DataFrame]) -> DataFrame:
            out = None
            for fresh in tables:
                out = fresh if out is None else small(out.unionByName(fresh))
                tidy(df.sparkSession)
            return out

        sketches = of_sets(nodes, "sketch", _sketches)
        sketches_at_once = WIDE * max(SETS_AT_ONCE * sketches.count(), AT_ONCE)

        def compared(rows: DataFrame) -> DataFrame:
            near = together(_close(part, sketches, percent, block) for part in in_turns(rows, sketches_at_once))
            grams = of_sets(near.select("s").distinct(), "grams", _grams)
            return together(small(_links(part, grams, percent)) for part in in_turns(near, max(SETS_AT_ONCE * grams.count(), AT_ONCE)))

        # Stars, in blocks: the centre is in each block of its star.
        blocks = small(stars.groupBy("c").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")))
        placed = stars.join(blocks, "c").withColumn("g", F.xxhash64("c", F.pmod(F.xxhash64("s"), F.col("blocks"))))
        centres = blocks.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")).select(F.xxhash64("c", "k").alias("g"), F.col("c").alias("s"))
        meet = placed.select("g", "s").unionByName(centres).select("g", F.lit(0).alias("side"), "s", F.col("s").alias("comp"))
        links = compared(meet)
        joined = small(components(links))
        tidy(df.sparkSession)

        # Parts of several components: rows outside the largest meet all; a part's first row met all others.
        family = components(stars.select(F.col("c").alias("a"), F.col("s").alias("b"))).select(F.col("node").alias("s"), F.col("root").alias("family"))
        family = small(family.join(joined.withColumnRenamed("node", "s"), "s", "left").select("s", "family", F.coalesce("root", "s").alias("comp")))
        tidy(df.sparkSession)
        # Of a part, number and sum of rows tell whether another has the same rows.
        counts = members.join(family, "s").groupBy("key", "family", "comp").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("s")).alias("sum"))
        sizes = counts.groupBy("key", "family").agg(F.sum("rows").alias("all"), F.bit_xor("sum").alias("sum"), F.max(F.struct("rows", "comp")).alias("top")).where(F.col("all") > F.col("top.rows"))
        parts = stored(sizes.groupBy("family", "all", "sum").agg(F.min(F.struct("key", "top")).alias("k")).select("family", F.col("k.key").alias("key"), "all", F.col("k.top").alias("top")))
        cost = parts.groupBy("family").agg(F.sum(F.expr("double(all - top.rows) * all")).alias("cost"))
        counts = family.join(cost.select("family"), "family").groupBy("family", "comp").agg(F.count("*").alias("rows"))
        sizes = counts.groupBy("family").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "comp")).alias("top"))
        families = small(sizes.join(cost, "family").select("family", "all", "top", (F.col("cost") <= F.expr("double(all - top.rows) * all")).alias("by_part")))
        wide = block * WIDE
        blocks = [F.col("top.comp").alias("top"), F.ceil((F.col("all") - F.col("top.rows")) / wide).alias("outer"), F.ceil(F.col("all") / wide).alias("every")]
        by_part = parts.join(families.where("by_part").select("family"), "family", "left_semi").select("key", *blocks)
        open_rows = members.select("key", "s").join(by_part, "key").join(family.select("s", "comp"), "s").select(F.xxhash64("key", F.lit(1)).alias("unit"), "s", "comp", "top", "outer", "every")
        whole = family.join(families.where("not by_part").select("family", *blocks), "family").select(F.xxhash64("family", F.lit(2)).alias("unit"), "s", "comp", "top", "outer", "every")
        open_rows = stored(open_rows.unionByName(whole))
        tidy(df.sparkSession)
        aside = open_rows.where("comp <> top").select("unit", "s", "comp", F.pmod(F.xxhash64("s"), F.col("outer")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("every") - 1)).alias("j"), F.lit(0).alias("side"))
        every = open_rows.select("unit", "s", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("i"), F.pmod(F.xxhash64("s", F.lit(1)), F.col("every")).alias("j"), F.lit(1).alias("side"))
        meet = aside.unionByName(every).select(F.xxhash64("unit", "i", "j").alias("g"), "side", "s", "comp")
        more = compared(meet)
        found = joined if more.isEmpty() else components(links.unionByName(more))
        found = found.withColumnRenamed("node", "s")

    # Names of components: the smallest id of any of their documents.
    if found is not None:
        roots = stored(least.join(found, "s", "left").withColumn("root", F.coalesce("root", "s")))
        ids = stored(roots.groupBy("root").agg(F.min("least").alias("component")))
        least = stored(roots.join(ids, "root").select("s", F.col("component").alias("least")))
        tidy(df.sparkSession)
    named = rows.join(least, "s", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("d"))
    return named.withColumn("component", component).select(back_to_id("d").alias("doc_id"), F.col("n").alias("n_shingles"), back_to_id("component").alias("component_id"))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3, percent: int = 90) -> DataFrame:
    """``df`` with one document of each group of linked ones: that of the smallest id."""
    groups = similar_documents(df, text, doc_id, n, percent)
    gone = _bounded(stored(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(row_id("doc_id").alias("_row")).distinct()))
    tidy(df.sparkSession)
    rows = df.withColumn("_row", row_id(doc_id))
    if rows.groupBy("_row").count().where("count > 1").head(1):  # equal rows once
        rows = rows.withColumn("_text", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates(["_row", "_text"])
    return rows.join(gone, "_row", "left_anti").select(*df.columns)
