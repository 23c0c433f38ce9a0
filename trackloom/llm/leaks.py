"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item leaks into a document if some span of the text is within ``tolerance(n)`` edits of the item's n
bytes. Edits are of UTF-8 bytes. The steps, all inside one pass over the documents and without a shuffle:

1. Item-sized windows are placed where they can match. An item has ``n // 8`` disjoint segments of
   8 bytes and an edit spoils one of them at most, so a match keeps ``n // 8 - tolerance(n)`` of them
   unchanged and in place within the tolerance; other places hold no match. This loses nothing.
2. Each window and each item is embedded by CGK random walks: a step emits the byte under the pointer,
   and a random bit of (step, byte) says whether the pointer moves on; few edits become few differing
   places. Random places of the walk form an LSH key; ``walks * samples`` keys give the target recall.
3. Windows that share a key with their item are verified by bit-parallel edit distance of the item
   against the text around the window.

The benchmark is a stated query set: it is read in blocks of at most ``block_bytes``, each checked against all
documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels

SEGMENT = 8
WALKS, SAMPLES, PLACES = 16, 24, 3
MAX_RATE = 0.1


def tolerance(n: int) -> int:
    """Edits allowed for an item of n bytes: a tenth, and fewer than its segments."""
    return max(0, min(int(n * MAX_RATE), n // SEGMENT - 1))


@dataclass
class Items:
    """A block of items, as numpy arrays that travel to the tasks."""

    ids: list
    texts: list[bytes]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    allowed: np.ndarray
    need: np.ndarray
    signatures: np.ndarray
    seed: int
    short: list


def _walk(blocks: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """LSH keys, (texts, walks * samples), of zero-padded byte rows.

    Step and walk decide the random bit for a byte. The places that are sampled are shares of the walk's
    length, twice the text's, so texts of one length share them.
    """
    rng = np.random.default_rng(seed)
    chosen = rng.random((WALKS, SAMPLES, PLACES))
    words = np.arange(WALKS * 4, dtype=np.uint64)
    keys = np.empty((len(blocks), WALKS * SAMPLES), np.uint64)
    longest = int(lengths.max(initial=0))
    padded = np.concatenate((blocks[:, :longest], np.zeros((len(blocks), 1), np.uint8)), axis=1)
    base = np.arange(WALKS)[None, :] * 256
    for part in np.array_split(np.arange(len(blocks)), 1 + len(blocks) * WALKS * longest // (1 << 22)):
        own, end = padded[part], lengths[part][:, None]
        row = np.arange(len(part))[:, None]
        emitted = np.empty((2 * longest, len(part), WALKS), np.uint8)
        pointer = np.zeros((len(part), WALKS), np.int64)
        for step in range(2 * longest):
            # fresh random bits for each step, walk and byte
            move = np.unpackbits(kernels.mix64(words + np.uint64((seed << 40) + step * WALKS * 4)).view(np.uint8)).astype(np.int64)
            byte = own[row, pointer]
            emitted[step] = byte
            pointer = np.minimum(pointer + move[base + byte], end)
        key = np.tile(np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64).reshape(1, WALKS, SAMPLES), (len(part), 1, 1))
        walk = np.arange(WALKS)[None, :, None]
        for p in range(PLACES):
            place = (chosen[None, :, :, p] * (2 * end[:, :, None])).astype(np.int64)
            key = key * np.uint64(0x100000001B3) + emitted[place, row[:, :, None], walk].astype(np.uint64)
        keys[part] = key.reshape(len(part), -1)
    return keys


def _rows(texts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t[:width], np.uint8)
    return out


def prepare(rows: list[tuple[object, str | None]], seed: int = 11) -> Items:
    """Null or empty items match nothing; those of fewer than 8 bytes, which allow no edit, match as they stand."""
    short = [(i, t.encode()) for i, t in rows if t and len(t.encode()) < SEGMENT]
    rows = [(i, t.encode()) for i, t in rows if t is not None and len(t.encode()) >= SEGMENT]
    texts = [t for _, t in rows]
    lengths = np.array([len(t) for t in texts], np.int64)
    allowed = np.array([tolerance(len(t)) for t in texts], np.int64)
    where = [(np.frombuffer(t[o : o + SEGMENT], "<u8")[0], i, o) for i, t in enumerate(texts) for o in range(0, len(t) - SEGMENT + 1, SEGMENT)]
    where.sort(key=lambda x: (int(x[0]), x[1], x[2]))
    segment = np.array([x[0] for x in where], np.uint64)
    keys, first = np.unique(segment, return_index=True)
    return Items(
        [i for i, _ in rows], texts, keys, np.append(first, len(where)), np.array([x[1] for x in where], np.int64), np.array([x[2] for x in where], np.int64),
        allowed, lengths // SEGMENT - allowed, _walk(_rows(texts, int(lengths.max(initial=0))), lengths, seed) if texts else np.zeros((0, WALKS * SAMPLES), np.uint64), seed, short,
    )


def edit_distance_within(item: bytes, text: bytes) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``item`` to a span of ``text``, and where the first such span ends.

    Myers' bit-parallel recurrence on one Python integer.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def windows(items: Items, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, start) of every item-sized window that keeps enough segments of its item."""
    none = np.zeros(0, np.int64)
    if len(data) < SEGMENT or not len(items.keys):
        return none, none, none
    view = np.ndarray((len(data) - SEGMENT + 1,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    shift, odd = np.uint64(44), np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(1 << 20, bool)
    table[(items.keys * odd) >> shift] = True
    found = [p + np.flatnonzero(table[(view[p : p + (1 << 16)] * odd) >> shift]) for p in range(0, len(view), 1 << 16)]
    at = np.concatenate(found)
    value = view[at]
    key = np.searchsorted(items.keys, value)
    key[key == len(items.keys)] = 0
    same = items.keys[key] == value
    at, key = at[same], key[same]
    text = kernels.text_index(at, offsets)
    inside = at + SEGMENT <= offsets[text + 1]
    at, key, text = at[inside], key[inside], text[inside]
    n = items.first[key + 1] - items.first[key]
    entry = np.repeat(items.first[key] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    item, start, text, offset = items.item[entry], np.repeat(at, n) - items.offset[entry], np.repeat(text, n), items.offset[entry]
    if not len(item):
        return none, none, none
    # a hit speaks for windows that begin up to twice the tolerance before it; a segment counts once for a window
    pair, reach = text * len(items.texts) + item, 2 * items.allowed[item]
    order = np.lexsort((start, offset, pair))
    p, o, b, r = pair[order], offset[order], start[order], reach[order]
    apart = np.append(True, (p[1:] != p[:-1]) | (o[1:] != o[:-1]) | (b[1:] - b[:-1] > r[1:]))
    begin, last = np.flatnonzero(apart), np.append(np.flatnonzero(apart)[1:], len(p)) - 1
    where, step, whose = np.concatenate((b[begin] - r[begin], b[last] + 1)), np.repeat([1, -1], len(begin)), np.concatenate((p[begin], p[begin]))
    order = np.lexsort((step, where, whose))
    where, whose, depth = where[order], whose[order], np.cumsum(step[order])
    full = np.flatnonzero(depth >= items.need[whose % len(items.texts)])
    if not len(full):
        return none, none, none
    wide = len(data) + 4 * int(items.allowed.max()) + max(map(len, items.texts)) + 1  # so that numbers of different pairs lie apart
    base = wide - len(data) - 1
    low, high = whose[full] * wide + where[full] + base, whose[full] * wide + where[full + 1] - 1 + base
    last = np.searchsorted(low, pair * wide + start + base, "right") - 1  # the last full stretch that begins at or before the hit
    ok = (last >= 0) & (high[last] >= pair * wide + np.maximum(start - reach, -base) + base)
    item, start, text = item[ok], start[ok], text[ok]
    order = np.lexsort((start, item, text))
    item, start, text = item[order], start[order], text[order]
    # of starts that differ by less than a quarter of the tolerance, the one with most hits stands for all
    first = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (text[1:] != text[:-1])))
    hits = np.diff(np.append(first, len(item)))
    item, start, text = item[first], start[first], text[first]
    group = start // np.maximum(1, items.allowed[item] // 4)
    order = np.lexsort((start, -hits, group, item, text))
    item, start, text, group = item[order], start[order], text[order], group[order]
    new = np.append(True, (item[1:] != item[:-1]) | (group[1:] != group[:-1]) | (text[1:] != text[:-1]))
    return text[new], item[new], start[new]


def search(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int, int, int]]:
    """(text, item's id, item's bytes, end, distance) of each leak; the best place of an item in a text counts."""
    found = [(t, items.ids[k], len(items.texts[k]), end, d) for t, k, end, d in _search(items, data, offsets)]
    raw = data.tobytes() if items.short else b""
    for i, text in items.short:
        at, last = raw.find(text), -1
        while at >= 0:
            t = int(kernels.text_index(np.array([at]), offsets)[0])
            if at + len(text) <= offsets[t + 1] and t != last:
                found.append((t, i, len(text), at + len(text) - int(offsets[t]), 0))
                last = t
            at = raw.find(text, int(offsets[t + 1]) if t == last else at + 1)
    return found


def _search(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, end, distance) of each leak of an item of 8 bytes or more."""
    text, item, start = windows(items, data, offsets)
    if not len(text):
        return []
    lengths = np.array([len(t) for t in items.texts])[item]
    low, high = offsets[text], offsets[text + 1]
    close = np.zeros(len(text), bool)
    for part in np.array_split(np.arange(len(text)), 1 + len(text) // 4096):
        place = start[part][:, None] + np.arange(lengths[part].max())[None, :]
        block = np.where((place >= low[part][:, None]) & (place < high[part][:, None]), data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)
        close[part] = (_walk(block, lengths[part], items.seed) == items.signatures[item[part]]).any(axis=1)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for i in np.flatnonzero(close):
        t, k, n, most = int(text[i]), int(item[i]), int(lengths[i]), int(items.allowed[item[i]])
        if best.get((t, k), (1, 0))[0] == 0:
            continue
        a, b = max(int(low[i]), int(start[i]) - most), min(int(high[i]), int(start[i]) + n + most)
        distance, end = edit_distance_within(items.texts[k], data[a:b].tobytes())
        if distance <= most and distance < best.get((t, k), (most + 1, 0))[0]:
            best[t, k] = distance, a + end - int(offsets[t])
    return [(t, k, end, d) for (t, k), (d, end) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int = 4 << 20):
    """The benchmark's items in prepared blocks."""
    rows, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((item_id, text))
        size += len(text or "")
        if size >= block_bytes:
            yield prepare(rows)
            rows, size = [], 0
    yield prepare(rows)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, item_id, end_byte, item_bytes, distance.

    ``end_byte`` is where the best matching span ends. Null and empty items or texts match nothing; items of fewer than 16 bytes match
    without edits only. Repeated rows give repeated results; ids may be null and of any type; other columns of either table are ignored.
    Texts are read whole, however long. An empty table of either kind gives an empty table.
    """
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("end_byte", T.LongType()), T.StructField("item_bytes", T.LongType()), T.StructField("distance", T.IntegerType())])
    out, ids_type = None, to_arrow_type(benchmark.schema["item_id"].dataType)
    for items in item_blocks(benchmark, block_bytes):

        def task(batches, items=items):
            for batch, data, offsets in kernels.slices(batches):
                hits = search(items, data, offsets)
                if hits:
                    ids = batch.column(0).take(pa.array([h[0] for h in hits]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([h[1] for h in hits], ids_type), pa.array([h[3] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[4] for h in hits], pa.int32())],
                        names=["doc_id", "item_id", "end_byte", "item_bytes", "distance"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(task, schema)
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    for items in item_blocks(benchmark, block_bytes):

        def task(batches, items=items):
            for batch, data, offsets in kernels.slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in search(items, data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(task, docs.schema)
    return docs


def op6_leaks(spark, sf_dir):
    """All documents against the whole benchmark."""
    from .common import documents, table

    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
