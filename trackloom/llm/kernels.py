"""Numpy work on the bytes of many texts at once, for use inside Arrow tasks.

A batch of texts is one byte array and the offsets of its texts; nothing here makes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and shift, as in splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in runs of rows with about ``limit`` bytes of text (a longer text comes alone)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs where ``inside`` holds, cut at the texts' borders."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: maximal runs of bytes that are not ASCII blanks."""
    return runs(~BLANK[data], offsets)


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 22)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * (out[done - 1 : done] * base)
                done += step
            _powers[i] = out
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    return _power(n)[1]


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each window of w values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def least_at(hashes: np.ndarray, w: int, part: int = 1 << 22) -> np.ndarray:
    """Position of the least of each window of w hashes, by their high 36 bits; the rightmost of equal ones."""
    out = np.empty(max(0, len(hashes) - w + 1), np.int64)
    low = np.uint64((1 << 28) - 1)
    for a in range(0, len(out), part):  # so that positions within a part fit in 28 bits, however long the text
        own = hashes[a : a + part + w - 1]
        packed = (own & ~low) | (low - np.arange(len(own), dtype=np.uint64))
        out[a : a + part] = a + (low - (sliding_least(packed, w) & low)).astype(np.int64)
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, independent of where they stand."""
    return mix64((sums[ends] - sums[starts]) * _power(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_index(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of a text, and the text's index.

    A text of fewer words, one at least, has one shingle of all of them.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        if len(out):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    whole = owner[: len(out)] == owner[k - 1 : k - 1 + len(out)] if len(out) else np.zeros(0, bool)
    out, own = mix64(out[whole]), owner[: len(whole)][whole]
    counts = np.bincount(owner)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = extra[has] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[short[has]] + j]
        out, own = np.concatenate((out, mix64(extra + np.uint64(1)))), np.concatenate((own, short))
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
