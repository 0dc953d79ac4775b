"""Whole columns of text as flat numpy arrays, for functions that run inside mapInArrow.

A record batch is cut into pieces of a few MB, so memory does not depend on the
batch; one text is never cut.  Hashes are differences of prefix sums of a
polynomial modulo 2^64, so every window of a piece is hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = have = (made[0], made[1])
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of values[i] * base^i, one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE, salt: int = 0) -> np.ndarray:
    """Hash of values[start:end] for arrays of starts and ends, the same wherever the span stands."""
    raw = (sums[end] - sums[start]) * powers(len(sums), base)[1][start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), salt)


@dataclass
class Texts:
    """Texts of a piece: bytes of all, and where each begins and ends; a null is empty."""

    batch: pa.RecordBatch
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; nulls are empty."""
    large = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    raw = large.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[Texts]:
    """The rows of all batches, in order, in pieces of at most ``most`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            base = offsets[at]
            yield Texts(batch.slice(at, to - at), data[base:offsets[to]], offsets[at:to] - base, offsets[at + 1:to + 1] - base)
            at = to


@dataclass
class Words:
    """Words of a piece: their hash, place and document; ``first`` and ``count`` give each document's words."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    hash: np.ndarray


def words(texts: Texts, lower: bool = False) -> Words:
    """Words between ASCII white space, A-Z in lower case if asked for."""
    data = _LOWER[texts.data] if lower else texts.data
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[texts.begin] = True
    edge[n] = True
    inside = np.empty(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    inside[n] = False
    before = np.zeros(n, bool)
    before[1:] = inside[:n - 1] if n else False
    start = np.flatnonzero(inside[:n] & (~before | edge[:n]))
    end = np.flatnonzero(inside[:n] & (~inside[1:] | edge[1:])) + 1
    first = np.searchsorted(start, texts.begin)
    count = np.searchsorted(start, texts.end) - first
    sums = prefix(_BYTE[data])
    return Words(start, end, np.repeat(np.arange(len(count)), count), first, count, span_hash(sums, start, end))


def runs(positions: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [p, p + width) for sorted positions of each document: (doc, start, end) of the maximal runs."""
    if not len(positions):
        return doc[:0], positions[:0], positions[:0]
    new = np.ones(len(positions), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (positions[1:] > positions[:-1] + width)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(positions)) - 1
    return doc[at], positions[at], positions[last] + width


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count)
