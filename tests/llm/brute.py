"""Plain versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def substrings(docs: list[tuple[int, str | None]], window: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(kept))))
    return sorted(out)


def suffixes(docs: list[tuple[int, str | None]], window: int) -> list[tuple]:
    first: dict[bytes, tuple] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - window + 1):
            k = b[p : p + window]
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < (i, p):
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return sorted(out)


def jaccard(docs: list[tuple[int, str | None]], n: int, percent: int) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = {k: k for k in range(len(sets))}

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                parent[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(x), least[top(k)]) for k, (i, x) in enumerate(sets))


def lines(docs: list[tuple[int, str | None]], least: int) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    count: dict[str, int] = {}
    split = [(i, (t or "").split("\n")) for i, t in docs]
    for _, ls in split:
        for k in {key(x) for x in ls} - {""}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, ls in split:
        kept = [x for x in ls if count.get(key(x), 0) < least]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def payload(text: str | None) -> tuple:
    import zlib

    raw = (text or "").encode()
    body = raw + bytes(-len(raw) % 64 if raw else 64)
    return len(raw), len(body), sha(body), zlib.crc32(body[-64:])
