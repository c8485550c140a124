"""Languages of words and documents by a linear-chain conditional random field.

Each word of a text has a label, its language.  Its features are byte n-grams,
affixes and the word itself (lexicon), all looked up in hashed tables of weights;
learned transitions link neighbouring labels.  Forward-backward gives each word's
label probabilities, so that code-switched text gets labels word by word; their
mean over the words with letters is the document's.

Forward-backward runs over all documents of a piece at once: words are cut into
segments of equal length, whose transfer matrices are computed side by side,
chained document by document, and then filled in.  This is exact.

The model is fitted on the driver on a bounded sample: ``per_language`` labelled
documents of each language of at most ``longest`` bytes, the smallest by hash of
their ids.  Labelled documents are spliced into code-switched sequences, from
which transitions are learned.  Ids whose CRC-32 leaves 2 modulo 4 are held out:
nothing is learned from them.

Defined results: null text, or text without a letter, is ``und`` with score 0, and
so is all text if nothing is labelled; null labels are not learned from, null ids
neither, and those are not held out; ties go to the first language by name;
repeated rows get equal results; whole texts count, however long; other columns
pass where asked for, but for columns named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, Polynomial, Powers, Words, expand, flat, mix, pieces
from .shared import give_back

PER_LANGUAGE, LONGEST, EPOCHS, SEED = 300, 20_000, 4, 5
PIECE, SEGMENT = 1 << 18, 48
#: Sizes, in bits, of the tables of n-grams of 2 and 3 bytes, prefixes, suffixes and words.
BITS = {"two": 16, "three": 17, "prefix": 16, "suffix": 16, "lexicon": 17}
NONE = "und"


def normal_table() -> np.ndarray:
    """Bytes with A-Z lower-cased and every other ASCII byte but a-z turned to a space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


class Features:
    """Feature numbers of the words of several documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tables: Powers):
        words = Words(data, offsets)
        self.offsets, n = words.offsets, len(words.start)
        text = normal_table()[data]
        if len(text) > 1:  # capital letters of the Latin-1 block in UTF-8
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            text[1:][capital] += 0x20
        letters = np.flatnonzero(text != 32)
        a, b = np.searchsorted(letters, words.start), np.searchsorted(letters, words.end)
        self.solid = b > a
        first, last = words.start.copy(), words.start.copy()
        first[self.solid], last[self.solid] = letters[a[self.solid]], letters[b[self.solid] - 1] + 1
        #: Places of the bytes of each word's letters, word by word.
        self.count = last - first
        at = expand(first, self.count)
        self.word = np.repeat(np.arange(n), self.count)
        framed = np.concatenate([np.full(4, 32, np.uint8), text, np.full(4, 32, np.uint8)]).astype(np.int64)
        edge = np.zeros(len(text) + 8, bool)
        edge[4 + first[self.solid] - 1] = edge[4 + last[self.solid]] = True
        inner = np.where(edge, 32, framed)  # what stands beside a word is a space
        at4 = at + 4
        before, here, after = inner[at4 - 1], framed[at4], inner[at4 + 1]
        self.two = before << 8 | here
        self.three = self._fold(before << 16 | here << 8 | after, BITS["three"])
        end4 = last + 4
        head = np.zeros(n, np.int64)
        tail = np.zeros(n, np.int64)
        for k in range(4):
            head = head << 8 | np.where(k < self.count, framed[first + 4 + k], 32)
            tail = tail << 8 | np.where(k < self.count, framed[end4 - 1 - k], 32)
        self.prefix, self.suffix = self._fold(head, BITS["prefix"]), self._fold(tail, BITS["suffix"])
        whole = Polynomial(text, tables).spans(first, last)
        self.lexicon = (whole >> U64(64 - BITS["lexicon"])).astype(np.int64)

    @staticmethod
    def _fold(x: np.ndarray, bits: int) -> np.ndarray:
        return (mix(x.astype(U64)) >> U64(64 - bits)).astype(np.int64)

    def scores(self, weights: dict[str, np.ndarray], bias: np.ndarray) -> np.ndarray:
        """Weights summed over each word's features: words x labels."""
        per_byte = weights["two"][self.two] + weights["three"][self.three]
        sums = np.zeros((len(per_byte) + 1, per_byte.shape[1]))
        np.cumsum(per_byte, axis=0, out=sums[1:])
        ends = np.cumsum(self.count)
        out = sums[ends] - sums[ends - self.count]
        out += weights["prefix"][self.prefix] + weights["suffix"][self.suffix] + weights["lexicon"][self.lexicon]
        out[~self.solid] = 0
        return out + bias

    def gradients(self, error: np.ndarray) -> dict[str, np.ndarray]:
        error = np.where(self.solid[:, None], error, 0)
        out = {}
        for name, bits in BITS.items():
            index = getattr(self, name)
            own = error[self.word] if name in ("two", "three") else error
            out[name] = np.stack([np.bincount(index, own[:, k], 1 << bits) for k in range(error.shape[1])], 1)
        return out


def marginals(scores: np.ndarray, offsets: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of each word; with ``pairs`` also expected transition counts."""
    n, labels = scores.shape
    if not n:
        return scores, np.zeros((labels, labels)) if pairs else None
    step = np.exp(transition - transition.max())
    emit = np.exp(scores - scores.max(1, keepdims=True))
    lengths = np.diff(offsets)
    per_doc = -(-lengths // SEGMENT)
    first_segment = np.cumsum(per_doc) - per_doc
    total = int(per_doc.sum())
    owner = np.repeat(np.arange(len(lengths)), per_doc)
    start = offsets[:-1][owner] + SEGMENT * (np.arange(total) - first_segment[owner])
    size = np.minimum(SEGMENT, offsets[1:][owner] - start)
    place = start[None, :] + np.arange(SEGMENT)[:, None]
    there = np.arange(SEGMENT)[:, None] < size[None, :]
    place = np.where(there, place, 0)

    # What a whole segment does to any state before it; a document's first word has none before it.
    opens = np.zeros(total, bool)
    opens[first_segment[lengths > 0]] = True
    whole = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for k in range(SEGMENT):
        rows = np.flatnonzero(there[k])
        part = whole[rows]
        moved = part @ step
        if k == 0:
            moved[opens[rows]] = part[opens[rows]]
        moved *= emit[place[k, rows]][:, None, :]
        whole[rows] = moved / moved.max((1, 2), keepdims=True)
    enter = np.full((total, labels), 1.0 / labels)
    leave = np.ones((total, labels))
    for k in range(1, int(per_doc.max())):
        rows = first_segment[per_doc > k] + k
        state = np.einsum("ij,ijk->ik", enter[rows - 1], whole[rows - 1])
        enter[rows] = state / state.max(1, keepdims=True)
    for k in range(1, int(per_doc.max())):
        docs = per_doc > k
        rows = (first_segment + per_doc)[docs] - 1 - k
        state = np.einsum("ijk,ik->ij", whole[rows + 1], leave[rows + 1])
        leave[rows] = state / state.max(1, keepdims=True)

    forward = np.empty((n, labels))
    state = enter.copy()
    for k in range(SEGMENT):
        rows = np.flatnonzero(there[k])
        now = state[rows]
        moved = now @ step
        if k == 0:
            moved[opens[rows]] = now[opens[rows]]
        moved *= emit[place[k, rows]]
        moved /= moved.max(1, keepdims=True)
        state[rows] = forward[place[k, rows]] = moved
    backward = np.empty((n, labels))
    state = leave.copy()
    for k in range(SEGMENT - 1, -1, -1):
        rows = np.flatnonzero(there[k])
        at = place[k, rows]
        backward[at] = state[rows]
        moved = (state[rows] * emit[at]) @ step.T
        state[rows] = moved / moved.max(1, keepdims=True)
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    if not pairs:
        return both, None
    after = np.ones(n, bool)
    after[offsets[:-1][lengths > 0]] = False
    x = np.flatnonzero(after)
    ahead = emit[x] * backward[x]
    norm = np.einsum("ij,jk,ik->i", forward[x - 1], step, ahead)
    return both, step * np.einsum("ij,ik->jk", forward[x - 1] / norm[:, None], ahead)


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def spliced(texts: list[list[bytes]], rng: np.random.Generator) -> tuple[list[bytes], list[np.ndarray]]:
    """Sequences of runs of words from one to three languages, and each word's label."""
    runs = [(label, ws) for label, docs in enumerate(texts) for ws in (d.split() for d in docs) if ws]
    order = rng.permutation(len(runs))
    out, labels = [], []
    at = 0
    while at < len(order):
        take = int(rng.integers(1, 4))
        words, marks = [], []
        for k in order[at : at + take]:
            label, ws = runs[k]
            words += ws
            marks += [label] * len(ws)
        out.append(b" ".join(words))
        labels.append(np.asarray(marks))
        at += take
    return out, labels


def fit(samples: dict[str, list[str]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.5, batch: int = 24, ridge: float = 1e-4) -> Model:
    """A field fitted to labelled texts by AdaGrad on the likelihood of all labels."""
    languages = sorted(samples)
    n = len(languages)
    model = Model(languages, {k: np.zeros((1 << bits, n)) for k, bits in BITS.items()}, np.zeros(n), np.zeros((n, n)))
    if n < 2:
        return model
    sums = {k: np.full(v.shape, 1e-2) for k, v in model.weights.items()}
    sums |= {"bias": np.full(n, 1e-2), "transition": np.full((n, n), 1e-2)}
    rng, tables = np.random.default_rng(seed), Powers()
    texts = [[t.encode() for t in samples[x]] for x in languages]
    for _ in range(epochs):
        sequences, labels = spliced(texts, rng)
        for a in range(0, len(sequences), batch):
            part, gold = sequences[a : a + batch], np.concatenate(labels[a : a + batch])
            offsets = np.r_[0, np.cumsum([len(x) for x in part])]
            features = Features(np.frombuffer(b"".join(part), np.uint8), offsets, tables)
            own, pairs = marginals(features.scores(model.weights, model.bias), features.offsets, model.transition, True)
            error = own.copy()
            error[np.arange(len(gold)), gold] -= 1
            after = np.ones(len(gold), bool)
            after[features.offsets[:-1]] = False
            x = np.flatnonzero(after)
            pairs -= np.bincount(gold[x - 1] * n + gold[x], minlength=n * n).reshape(n, n)
            scale = 1.0 / max(1, len(part))
            slopes = features.gradients(error) | {"bias": error.sum(0), "transition": pairs}
            for name, slope in slopes.items():
                value = model.weights.get(name, getattr(model, name, None))
                slope = slope * scale + ridge * value
                sums[name] += slope * slope
                value -= rate * slope / np.sqrt(sums[name])
    model.weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(df: DataFrame, text: str, doc_id: str, lang: str, per_language: int, longest: int) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each language: those of the smallest id hashes."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).agg(F.count("*")).collect()}  # a row a language
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(SEED)), F.lit(1 << 30))
    rates = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2.0 * per_language / n) * (1 << 30)))))
    near = labelled.where((place < rates[F.col(lang).cast("string")]) & F.col(text).isNotNull() & (F.octet_length(text) <= longest))
    rows = near.select(F.col(lang).cast("string").alias("lang"), place.alias("place"), F.col(text).cast("string").alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():  # about twice the sample
        found.setdefault(r["lang"], []).append((r["place"], r["text"]))
    return {k: [t for _, t in sorted(v)[:per_language]] for k, v in found.items()}


def train(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model:
    model = fit(samples(df, text, doc_id, lang, per_language, longest))
    give_back(df.sparkSession)
    return model


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 32
    plain = np.r_[0, np.cumsum((low >= 97) & (low <= 122) & (data < 128))][offsets]
    found = np.diff(plain) > 0
    wide = np.diff(np.r_[0, np.cumsum(data >= 128)][offsets]) > 0
    for k in np.flatnonzero(~found & wide).tolist():
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def label(df: DataFrame, model: Model, text: str = "text", with_spans: bool = False) -> DataFrame:
    """``df`` with lang_pred and score; with spans also (first word, words, language) of each run."""
    df = df.drop("lang_pred", "score", "lang_spans")
    at = df.columns.index(text)
    # Plain arrays: a broadcast names classes, which executors without this package do not have.
    shared = df.sparkSession.sparkContext.broadcast((list(model.languages), dict(model.weights), model.bias, model.transition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = Model(*shared.value), Powers()
        names = np.asarray([*known.languages, NONE], object)
        for batch in batches:
            data, offsets = flat(batch.column(at))
            picks, scores, spans = [], [], []
            for i, j in pieces(offsets, PIECE):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                best, score = np.full(j - i, len(names) - 1), np.zeros(j - i)
                some = _has_letter(own, off)
                if known.languages and some.any():
                    features = Features(own, off, tables)
                    chance, _ = marginals(features.scores(known.weights, known.bias), features.offsets, known.transition)
                    solid = np.zeros((len(chance) + 1, chance.shape[1]))
                    np.cumsum(np.where(features.solid[:, None], chance, 0), axis=0, out=solid[1:])
                    mass = np.diff(solid[features.offsets], axis=0)
                    total = mass.sum(1)
                    some &= total > 0
                    best[some] = mass[some].argmax(1)
                    score[some] = np.clip(mass[some].max(1) / total[some], 0, 1)
                    if with_spans:
                        top = chance.argmax(1)
                        for k in range(j - i):
                            own_top = top[features.offsets[k] : features.offsets[k + 1]]
                            cuts = np.r_[0, np.flatnonzero(own_top[1:] != own_top[:-1]) + 1, len(own_top)] if len(own_top) else np.zeros(1, np.int64)
                            spans.append([{"first": int(a), "words": int(b - a), "lang": known.languages[own_top[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                elif with_spans:
                    spans += [[] for _ in range(j - i)]
                picks.append(best)
                scores.append(score)
            best = np.concatenate(picks) if picks else np.zeros(0, int)
            score = np.concatenate(scores) if scores else np.zeros(0)
            arrays = [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            if with_spans:
                arrays.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "lang_pred", "score", *["lang_spans"] * with_spans])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if with_spans:
        run_of = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())])
        schema.add("lang_spans", T.ArrayType(run_of))
    return df.mapInArrow(run, schema)
