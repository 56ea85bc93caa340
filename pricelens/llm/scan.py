"""Vectorised word scanning of an Arrow text column (numpy over whole buffers, no per-word objects).

Words are hashed with a 64-bit polynomial over their bytes, read off prefix
sums, and finished with a bijective mix; two different words share a hash with
a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one numpy pass handles; longer texts are cut between words.
BLOCK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _classes(separators: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: is it part of a word; its value (A-Z as a-z) plus one."""
    value = np.arange(1, 257, dtype=np.uint64)
    value[0x41:0x5B] += np.uint64(32)
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    return word, value


#: Words are runs without space and \x09-\x0D.
SPACED = _classes({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, letters and everything outside ASCII (A-Z are lower-cased first).
ALNUM = _classes({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the int64 offsets of each."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of stretches to scan: texts, the long ones cut at a separator; and each stretch's text."""
    lengths = np.diff(offsets)
    if not (lengths > BLOCK).any():
        return offsets, np.arange(len(lengths))
    bounds, owner = [0], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > BLOCK:
            at = a + BLOCK
            while at < b:
                gap = np.flatnonzero(~word[data[at:at + 4096]])
                if len(gap):
                    at += int(gap[0])
                    break
                at += 4096
            if at >= b:
                break
            bounds.append(at)
            owner.append(k)
            a = at
        bounds.append(b)
        owner.append(k)
    return np.array(bounds, dtype=np.int64), np.array(owner, dtype=np.int64)


def word_bounds(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; no word spans two texts."""
    inside = word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def word_hashes(texts: pa.Array, classes: tuple[np.ndarray, np.ndarray], tails: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and the int64 bounds of each text's words; with ``tails`` also hashes of the words' last three bytes."""
    word, value = classes
    data, offsets = buffers(texts)
    bounds, owner = _segments(data, offsets, word)
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    out, endings, k = [], [], 0
    while k < len(owner):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK, "right")) - 1)
        part = data[bounds[k]:bounds[last]]
        inner = bounds[k:last + 1] - bounds[k]
        starts, ends = word_bounds(part, inner, word)
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(value[part] * up[:-1], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        if tails:
            code = np.zeros(len(ends), dtype=np.uint64)
            for back in (1, 2, 3):
                code = code << np.uint64(9) | np.where(ends - back >= starts, value[part[ends - back]], np.uint64(0))
            endings.append(mix(code))
        np.add.at(counts, owner[k:last], np.diff(np.searchsorted(starts, inner)))
        k = last
    at = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    whole = [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (out, endings)]
    return (whole[0], at, whole[1]) if tails else (whole[0], at)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` text bytes, so that memory does not grow with the batch."""
    for batch in batches:
        lengths = np.diff(buffers(batch.column(column))[1])
        total = np.cumsum(lengths)
        k = 0
        while k < batch.num_rows:
            done = total[k - 1] if k else 0
            last = max(k + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(k, last - k)
            k = last


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False), pa.int64())
