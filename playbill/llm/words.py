"""Words of many texts at once: positions, 64-bit hashes and shingles, by array operations on UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

from playbill.llm.arrow import SLICE, worker_cache

#: longer words are hashed one by one
LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: separators of running text, and of text reduced to letters and digits
SPACE_WORDS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
PLAIN_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    powers = worker_cache().setdefault("word_powers", [])
    if not powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SLICE + LONG_WORD + 1, base, np.uint64)
            steps[0] = 1
            powers.append(np.cumprod(steps, dtype=np.uint64))
    return powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes. Spans are sorted and do not overlap."""
    up, down = _tables()
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    done = 0
    while done < len(starts):
        if lengths[done] > LONG_WORD:
            digest = hashlib.blake2b(data[starts[done] : ends[done]].tobytes(), digest_size=8).digest()
            out[done] = int.from_bytes(digest, "little")
            done += 1
            continue
        base = starts[done]
        stop = int(np.searchsorted(starts, base + SLICE, "left"))
        giant = np.flatnonzero(lengths[done:stop] > LONG_WORD)
        if len(giant):
            stop = done + int(giant[0])
        s, e = starts[done:stop] - base, ends[done:stop] - base
        part = data[base : base + e[-1]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        out[done:stop] = (sums[e] - sums[s]) * down[s]
        done = stop
    return mix(out)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word and, for each row, the number of words before it. Words end at row borders."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    borders = offsets[1:-1]
    borders = borders[borders < len(data)]
    opens[borders] = inside[borders]
    starts = np.flatnonzero(opens)
    closes = inside[:-1] & ~inside[1:]
    closes[borders[borders > 0] - 1] = inside[borders[borders > 0] - 1]
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets, "left")


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values. For 64-bit hashes a sort is many times faster than ``np.unique``, which fills a hash table."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, width, np.uint64)
    for j in range(width):
        out *= _STEP
        out += hashes[j : j + count]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct word shingles of every row. Fewer words than ``width`` are one shingle, no words none."""
    lowered = LOWER[data]
    starts, ends, firsts = find_words(lowered, offsets, SPACE_WORDS)
    hashes = span_hashes(lowered, starts, ends)
    whole = fold(hashes, width)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= width:
            out.append(distinct(whole[a : b - width + 1]))
        else:
            out.append(fold(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
