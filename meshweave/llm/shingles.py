"""Sets of hashed word shingles, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19  # bytes worked on at once
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_value = (np.arange(1, 257, dtype=np.uint64) * A) ^ (np.arange(1, 257, dtype=np.uint64) * B >> np.uint64(17))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * A


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about CHUNK bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and where each text's words begin (one
    more entry than texts)."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    word = ~_space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(word)
    begin = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    power = np.ones(int(place.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, B, np.uint64), out=power[1:])
    h = np.add.reduceat(_value[data[at]] * power[place], begin)
    return mix(h), np.concatenate([[0], np.searchsorted(starts, ends)])


def sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, hashed, ascending. With fewer words, the
    whole sequence is the only one; without words there is none."""
    out = []
    for a, b in chunks(texts):
        words, begin = word_hashes(texts[a:b])
        grams = np.zeros(0, np.uint64)
        if len(words) >= n:
            grams = words[: len(words) - n + 1].copy()
            for i in range(1, n):
                grams = mix(grams) + words[i : len(words) - n + 1 + i]
            grams = mix(grams)
        for i in range(b - a):
            lo, hi = begin[i], begin[i + 1]
            if hi - lo >= n:
                out.append(np.unique(grams[lo : hi - n + 1]))
            elif hi > lo:
                h = words[lo]
                for k in range(lo + 1, hi):
                    h = (mix(words[k : k + 1]) + mix(np.array([h]))* B)[0]
                out.append(mix(np.array([h + np.uint64(hi - lo)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
