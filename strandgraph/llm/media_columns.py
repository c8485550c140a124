"""Telephony audio in columns: companded and ADPCM codes to resampled PCM.

Mu-law and A-law codes expand through tables of 256 samples, IMA ADPCM blocks
are decoded step by step with numpy across all blocks at once, and the samples
are resampled by linear interpolation.  Codes are stored in RIFF/WAVE form, which
keeps each code as it is, so that stored audio is lossless; PCM is derived and
stored beside it.  A text's bytes are mu-law codes, A-law codes or the nibbles of
ADPCM blocks, by the CRC-32 of its payload.

Defined results: null audio or text is empty; an empty payload is padded to one
unit of 64 bytes; equal input gives equal output; bytes after a RIFF chunk or a
short last ADPCM block are ignored; a stored form that is no RIFF file of a known
format raises ValueError; repeated rows give equal rows; of other columns
``decode_telephony`` passes all but those named like an output, and
``store_payloads`` none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import flat, pieces

#: RIFF format numbers of the ITU-T G.711 laws and of IMA ADPCM.
FORMATS = {"alaw": 6, "mulaw": 7, "ima": 17}
RATE, PCM_RATE, UNIT = 8000, 16000, 64
#: Codecs of stored texts, bytes of an ADPCM block's head, and bytes of text handled at once.
CODECS, HEAD, PIECE = ("mulaw", "alaw", "ima"), 4, 1 << 20


def mulaw_table() -> np.ndarray:
    """Samples of the 256 mu-law codes (ITU-T G.711): sign, exponent, mantissa, all inverted."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = ((2 * mantissa + 33) << (exponent + 2)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Samples of the 256 A-law codes (ITU-T G.711): even bits inverted."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, 2 * mantissa + 1, (2 * mantissa + 33) << np.maximum(exponent - 1, 0)) << 3
    return np.where(code & 128, size, -size).astype(np.int16)


# The step sizes and index changes of the IMA ADPCM recommendation.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def _ima_step(sample: np.ndarray, index: np.ndarray, nibble: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.asarray(STEPS, np.int32)[index]
    change = step >> 3
    for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
        change = change + np.where(nibble & bit, part, 0)
    sample = np.clip(sample + np.where(nibble & 8, -change, change), -32768, 32767)
    return sample, np.clip(index + np.asarray(CHANGES, np.int32)[nibble & 7], 0, len(STEPS) - 1)


def decode_ima(data: np.ndarray, block: int = 256) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks: one time step of all blocks at once."""
    blocks = data[: len(data) // block * block].reshape(-1, block)
    if not len(blocks):
        return np.zeros(0, np.int16)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    nibbles = np.empty((len(blocks), 2 * (block - 4)), np.uint8)
    nibbles[:, 0::2], nibbles[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((len(blocks), nibbles.shape[1] + 1), np.int16)
    out[:, 0] = sample = head
    for k in range(nibbles.shape[1]):
        sample, index = _ima_step(sample, index, nibbles[:, k])
        out[:, k + 1] = sample
    return out.reshape(-1)


def encode_ima(pcm: np.ndarray, block: int = 256) -> np.ndarray:
    """Mono IMA ADPCM blocks of PCM whose length is a multiple of 2*block - 7."""
    rows = pcm.reshape(-1, 2 * block - 7).astype(np.int32)
    sample, index = rows[:, 0], np.zeros(len(rows), np.int32)
    nibbles = np.empty((len(rows), rows.shape[1] - 1), np.uint8)
    for k in range(nibbles.shape[1]):
        rest = rows[:, k + 1] - sample
        step = np.asarray(STEPS, np.int32)[index]
        nibble, size = np.where(rest < 0, 8, 0), np.abs(rest)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            over = size >= part
            nibble, size = nibble + np.where(over, bit, 0), size - np.where(over, part, 0)
        nibbles[:, k] = nibble
        sample, index = _ima_step(sample, index, nibbles[:, k])
    out = np.zeros((len(rows), block), np.uint8)
    out[:, :2] = np.ascontiguousarray(rows[:, :1].astype("<i2")).view(np.uint8)
    out[:, 4:] = nibbles[:, 0::2] | nibbles[:, 1::2] << 4
    return out.reshape(-1)


def store(codes: bytes, codec: str = "mulaw", rate: int = RATE, block: int = 256) -> bytes:
    """A RIFF/WAVE file that holds the codes as they are."""
    ima = codec == "ima"
    align, bits, per = (block, 4, 2 * block - 7) if ima else (1, 8, 1)
    extra = struct.pack("<HH", 2, per) if ima else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * align // per, align, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(codes) // align * per)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(codes)) + codes + b"\0" * (len(codes) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read(media: bytes) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block size and codes of a stored file."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, found = 12, {}
    while at + 8 <= len(view):
        name, size = struct.unpack_from("<4sI", view, at)
        found[name] = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("a RIFF/WAVE file without fmt or data chunk")
    kind, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    names = {v: k for k, v in FORMATS.items()}
    if kind not in names:
        raise ValueError(f"RIFF format {kind} is not known here")
    return names[kind], rate, align, found[b"data"]


def samples(codec: str, codes: np.ndarray, tables: dict[str, np.ndarray], block: int = 256) -> np.ndarray:
    return decode_ima(codes, block) if codec == "ima" else tables[codec][codes]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; twice the rate is the plain case."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[1:] + wide[:-1]) >> 1
        out[-1] = pcm[-1]
        return out
    n = max(1, len(pcm) * to // rate)
    at = np.arange(n, dtype=np.int64) * rate
    low = np.minimum(at // to, len(pcm) - 1)
    high = np.minimum(low + 1, len(pcm) - 1)
    part = at % to
    return ((pcm[low].astype(np.int64) * (to - part) + pcm[high].astype(np.int64) * part) // to).astype(np.int16)


def law_tables() -> dict[str, np.ndarray]:
    return {"mulaw": mulaw_table(), "alaw": alaw_table()}


def feature(pcm: np.ndarray, codec: str) -> str:
    """Codec, samples, energy, peak and sign changes of PCM: whole numbers only."""
    energy = peak = signs = 0
    for a in range(0, len(pcm), PIECE):  # sums of a piece's squares are exact in doubles
        wide = pcm[a : a + PIECE + 1].astype(np.int32)
        own = wide[:PIECE]
        energy += int(np.dot(own.astype(np.float64), own))
        peak = max(peak, int(np.abs(own).max()))
        signs += int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{codec};n={len(pcm)};power={energy // max(1, len(pcm))};peak={peak};crossings={signs}"


def decode_telephony(df: DataFrame, media: str = "media", to: int = PCM_RATE) -> DataFrame:
    """``df`` with pcm (binary, 16 bit little-endian), pcm_rate and feature from stored files."""
    df = df.drop("pcm", "pcm_rate", "feature")
    at = df.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = law_tables()
        for batch in batches:
            pcm, rates, features = [], [], []
            for value in batch.column(at):
                if value.as_py() is None:
                    pcm.append(None), rates.append(None), features.append(None)
                    continue
                codec, rate, block, codes = read(value.as_py())
                wave = resample(samples(codec, np.frombuffer(codes, np.uint8), tables, block), rate, to)
                pcm.append(wave.astype("<i2").tobytes()), rates.append(to), features.append(feature(wave, codec))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pcm, pa.binary()), pa.array(rates, pa.int32()), pa.array(features, pa.string())], [*batch.schema.names, "pcm", "pcm_rate", "feature"])

    schema = T.StructType([*df.schema.fields]).add("pcm", "binary").add("pcm_rate", "integer").add("feature", "string")
    return df.mapInArrow(run, schema)


def codec_of(payload: bytes) -> str:
    """The codec that a payload is stored with: its CRC-32 modulo 3, so equal payloads have equal ones."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def framed(payload: bytes) -> bytes:
    """ADPCM blocks whose nibbles are the payload's bytes: each has a head of sample 0 and step 0, and one unit."""
    blocks = np.zeros((len(payload) // UNIT, HEAD + UNIT), np.uint8)
    blocks[:, HEAD:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return blocks.tobytes()


def unframed(codes: np.ndarray, block: int) -> np.ndarray:
    """The bytes of the nibbles of whole ADPCM blocks."""
    return codes[: len(codes) // block * block].reshape(-1, block)[:, HEAD:].reshape(-1)


def waves(stored: list[tuple[str, int, int, np.ndarray]], tables: dict[str, np.ndarray], to: int) -> list[np.ndarray]:
    """Resampled PCM of several files; the ADPCM blocks of all files of one block size are decoded together."""
    pcm: list[np.ndarray] = [np.zeros(0, np.int16)] * len(stored)
    for block in {b for kind, _, b, _ in stored if kind == "ima"}:
        own = [i for i, x in enumerate(stored) if x[0] == "ima" and x[2] == block]
        counts = [len(stored[i][3]) // block for i in own]
        wave = decode_ima(np.concatenate([stored[i][3][: n * block] for i, n in zip(own, counts, strict=True)]), block)
        ends = np.cumsum(counts) * (2 * block - 7)
        for i, part in zip(own, np.split(wave, ends[:-1]), strict=True):
            pcm[i] = part
    for i, (kind, rate, _, codes) in enumerate(stored):
        pcm[i] = resample(pcm[i] if kind == "ima" else tables[kind][codes], rate, to)
    return pcm


def store_payloads(df: DataFrame, text: str = "text", doc_id: str = "doc_id", codec: str | None = None, with_media: bool = False) -> DataFrame:
    """Each text's bytes as stored codes, read back and decoded: digests, feature, codec, bytes and digest of the PCM.

    The codec is that of the payload's CRC-32 (``codec_of``) unless one is given.
    With ``with_media`` the stored file and its resampled PCM (16 bit, little-endian)
    are columns too.
    """
    kinds = {
        "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
        "media_sha256": pa.string(), "feature": pa.string(), "codec": pa.string(), "pcm_bytes": pa.int64(), "pcm_sha256": pa.string(),
    }
    kinds |= {"media": pa.binary(), "pcm": pa.binary()} if with_media else {}
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(["doc_id long", *(f"{k} {sql[v]}" for k, v in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = law_tables()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets, PIECE):
                sizes, files = np.diff(offsets[i : j + 1]).tolist(), []
                for k, n in zip(range(i, j), sizes, strict=True):
                    payload = data[offsets[k] : offsets[k + 1]].tobytes() + bytes(-n % UNIT if n else UNIT)
                    own = codec or codec_of(payload)
                    files.append(store(framed(payload), own, block=HEAD + UNIT) if own == "ima" else store(payload, own))
                stored = [(kind, rate, block, np.frombuffer(codes, np.uint8)) for kind, rate, block, codes in map(read, files)]
                rows = []
                for n, media, (kind, _, block, codes), wave in zip(sizes, files, stored, waves(stored, tables, PCM_RATE), strict=True):
                    back, pcm = (unframed(codes, block) if kind == "ima" else codes).tobytes(), wave.astype("<i2").tobytes()
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest())
                    rows.append((*row, feature(wave, kind), kind, len(pcm), hashlib.sha256(pcm).hexdigest(), *((media, pcm) if with_media else ())))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", *kinds])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
