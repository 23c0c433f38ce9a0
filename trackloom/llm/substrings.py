"""Exact substring dedup: every byte covered by a ``LENGTH``-byte string that starts anywhere else, too, is removed.

Prefix doubling ranks all positions by ever longer prefixes. Sorting all of them at each doubling moves many times the corpus,
so the positions are thinned without loss first, and names (hashes) stand for ranks. Names are compared at growing
lengths, and what is unique drops out each time:

1. Of the ``LENGTH - GRAM + 1`` grams of GRAM bytes in a window of LENGTH bytes, the one with the least hash (the rightmost of several) is its
   anchor. Equal windows have equal anchors at the same place in them, so only anchors, one for about 80 bytes, are
   grouped; an anchor whose gram is unique drops out with all its windows.
2. The windows of one anchor follow each other. Where the whole stretch of text under them has an equal elsewhere, all are
   repeated. The rest are decided in blocks of ``BLOCK`` windows: the bytes that all windows of a block share must be repeated for
   any to be, and if all the bytes that the block covers are, every one is.
3. The blocks in between, at the ends of matches, are decided window by window.

Rows with equal names are gathered in each Arrow batch before they are shuffled, with a list of their places, so a passage that a third
of the corpus shares is a row for each batch. A group is then a window over one exchange; it is never collected.

Names are 64-bit hashes and are only compared within the same gram, which makes 128 bits. They are polynomials modulo 2 ** 64, which strings made for
it can defeat from 1,024 bytes on; no name here spans more than ``2 * LENGTH``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import Scratch, id_key, text_or_empty, written

LENGTH, GRAM, BLOCK = 200, 40, 8
#: Longer texts are searched in pieces of so many windows, to bound the memory of a task.
PIECE = 1 << 22


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]  # not nullable: joins then add no filters that would part equal exchanges


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    z = np.zeros(0, np.int64)
    if len(data) < length:
        return z, z, z, z, z, z
    sums = kernels.prefix_sums(data)
    names = kernels.mix64((sums[gram:] - sums[:-gram]) * kernels.inverse_powers(len(sums))[: len(sums) - gram])
    least = kernels.least_at(names, length - gram + 1)
    step = np.zeros(len(data) + 1, np.int32)
    big = np.diff(offsets) >= length
    np.add.at(step, offsets[:-1][big], 1)
    np.add.at(step, offsets[1:][big] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(step[: len(least)]) > 0)
    if not len(window):
        return z, z, z, z, z, z
    at = least[window]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)))
    lo, at, count = window[first], at[first], np.diff(np.append(first, len(window)))
    return kernels.text_index(lo, offsets), names[at].view(np.int64), kernels.span_hash(sums, lo, lo + count - 1 + length).view(np.int64), lo, count, at - lo


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """(text, gram's hash, whole stretch's hash, first window, windows, anchor's offset from the first window).

    A batch of more than two pieces is one long text; the stretch of an anchor is then cut where a piece ends.
    """
    if len(data) <= 2 * piece or len(offsets) > 2:
        return _anchors(data, offsets, length, gram)
    parts = []
    for a in range(0, len(data) - length + 1, piece):
        part = data[a : a + piece + length - 1]
        text, g, whole, lo, count, off = _anchors(part, np.array([0, len(part)]), length, gram)
        parts.append((text, g, whole, lo + a, count, off))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _gathered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where each group of equal keys begins in it)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _lists(begin: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), values)


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    """A row for each gram and whole stretch of a batch: gram, whole, n, count, off, places (id, tx, lo)."""
    place = T.StructType([keyed.schema["id"], *_fields("tx", "lo")])
    schema = T.StructType([*_fields("gram", "whole", "n", "count", "off"), T.StructField("places", T.ArrayType(place, False), False)])

    def task(batches):
        for batch, data, offsets in kernels.slices(batches, "text"):
            text, gram, whole, lo, count, off = anchors(data, offsets)
            order, begin = _gathered(gram, whole)
            owner, head = text[order], order[begin]
            places = pa.StructArray.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(lo[order] - offsets[owner])], names=["id", "tx", "lo"])
            n = np.diff(np.append(begin, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[head], whole[head], n, count[head], off[head])] + [_lists(begin, places)], names=schema.names)

    return keyed.select("id", "tx", "text").mapInArrow(task, schema)


def _stretches(texts: DataFrame) -> DataFrame:
    """(id, tx, wanted anchors, text) -> the anchors with the bytes under their windows."""
    schema = T.StructType([*_fields("gram", "whole", "n"), texts.schema["id"], *_fields("tx", "lo", "count", "off"), T.StructField("bytes", T.BinaryType(), False)])

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(3)[i].as_py().encode()
                wanted = batch.column(2)[i].as_py()
                same = [batch.column(c).take(pa.array([i] * len(wanted), pa.int64())) for c in (0, 1)]
                own = {c: pa.array([w[c] for w in wanted], pa.int64()) for c in ("gram", "whole", "n", "lo", "count", "off")}
                parts = pa.array([raw[w["lo"] : w["lo"] + w["count"] - 1 + LENGTH] for w in wanted], pa.binary())
                yield pa.RecordBatch.from_arrays([own["gram"], own["whole"], own["n"], *same, own["lo"], own["count"], own["off"], parts], names=schema.names)

    return texts.select("id", "tx", "w", "text").mapInArrow(task, schema)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [_column(batch, n).to_numpy(zero_copy_only=False) for n in names]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)


def _blocks(stretches: DataFrame) -> DataFrame:
    """A row for each core and hull of a batch: gram, core (name of the bytes in all windows of a block), hull (of all its bytes, if it is
    full: the stretch goes on at both its ends), n, refs (whole, block, n)."""
    ref = T.StructType(_fields("whole", "block", "n"))
    schema = T.StructType([*_fields("gram", "core", "hull"), T.StructField("full", T.BooleanType(), False), *_fields("n"), T.StructField("refs", T.ArrayType(ref, False), False)])

    def task(batches):
        for batch in batches:
            gram, whole, times, count, off = _numbers(batch, "gram", "whole", "n", "count", "off")
            data, at = _bytes(_column(batch, "bytes"))
            if not len(gram):
                continue
            sums = kernels.prefix_sums(data)
            # a window that starts e bytes before the anchor is in block e // BLOCK
            high, low = off // BLOCK, (off - count + 1) // BLOCK
            n = high - low + 1
            row = np.repeat(np.arange(len(n)), n)
            block = low[row] + np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
            anchor = at[row] + off[row]
            core = kernels.span_hash(sums, anchor - BLOCK * block, anchor - BLOCK * block - BLOCK + 1 + LENGTH).view(np.int64)
            full = (BLOCK * block + BLOCK - 1 <= off[row]) & (BLOCK * block >= (off - count + 1)[row])
            a = np.where(full, anchor - BLOCK * block - BLOCK + 1, 0)
            hull = np.where(full, kernels.span_hash(sums, a, np.where(full, a + BLOCK - 1 + LENGTH, 0)).view(np.int64), 0)
            order, begin = _gathered(gram[row], core, hull, full)
            head, own = order[begin], row[order]
            refs = pa.StructArray.from_arrays([pa.array(whole[own]), pa.array(block[order]), pa.array(times[own])], names=["whole", "block", "n"])
            columns = [pa.array(gram[row][head]), pa.array(core[head]), pa.array(hull[head]), pa.array(full[head]), pa.array(np.add.reduceat(times[own], begin)), _lists(begin, refs)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stretches.select("gram", "whole", "n", "count", "off", "bytes").mapInArrow(task, schema)


def _windows(chosen: DataFrame) -> DataFrame:
    """Stretches with the blocks to look into -> a row for each window's name in a batch: gram, name, n, places (id, tx, lo) of the stretches that are there once."""
    place = T.StructType([chosen.schema["id"], *_fields("tx", "lo")])
    schema = T.StructType([*_fields("gram", "name", "n"), T.StructField("places", T.ArrayType(place, False), False)])

    def task(batches):
        for batch in batches:
            gram, times, lo, count, off = _numbers(batch, "gram", "n", "lo", "count", "off")
            blocks, (data, at) = _column(batch, "blocks"), _bytes(_column(batch, "bytes"))
            n = np.diff(blocks.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n * BLOCK)
            if not len(row):
                continue
            e = (blocks.flatten().to_numpy(zero_copy_only=False)[:, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
            start = off[row] - e
            inside = (start >= 0) & (start < count[row])
            row, start = row[inside], start[inside]
            name = kernels.span_hash(kernels.prefix_sums(data), at[row] + start, at[row] + start + LENGTH).view(np.int64)
            order, begin = _gathered(gram[row], name)
            own, head = row[order], order[begin]
            single = times[own] == 1
            use = own[single]
            places = pa.StructArray.from_arrays([_column(batch, "id").take(pa.array(use)), _column(batch, "tx").take(pa.array(use)), pa.array((lo[row] + start)[order][single])], names=["id", "tx", "lo"])
            first = np.append(0, np.cumsum(single))[begin]
            yield pa.RecordBatch.from_arrays([pa.array(gram[row][head]), pa.array(name[head]), pa.array(np.add.reduceat(times[own], begin)), _lists(first, places)], names=schema.names)

    return chosen.mapInArrow(task, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and a hash of id and text."""
    text = text_or_empty()
    return docs.select("doc_id", id_key(docs).alias("id"), F.xxhash64("doc_id", text).alias("tx"), text.alias("text"))


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """id, tx, runs: the starts (bytes from 0) and numbers of consecutive windows that start elsewhere, too."""
    scratch = Scratch(keyed.sparkSession)
    one = W.partitionBy("gram", "whole").orderBy("place")
    known = _anchor_rows(keyed).withColumn("total", F.sum("n").over(W.partitionBy("gram"))).where("total > 1").withColumn("place", F.col("places")[0])
    known = known.withColumns({"nr": F.row_number().over(one), "n": F.sum("n").over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}).withColumn("least", F.min("n").over(W.partitionBy("gram")))
    known = scratch.keep(known.select("gram", "whole", "n", "least", "nr", "count", "off", "places"))

    reps = known.where("least = 1 and nr = 1").select("gram", "whole", "n", F.col("places")[0].alias("p"), "count", "off")
    lists = reps.groupBy("p.id", "p.tx").agg(F.collect_list(F.struct("gram", "whole", "n", "p.lo", "count", "off")).alias("w"))
    # a row for each text, also where rows repeat an id and a text; the groups are as the join leaves them
    texts = keyed.select("id", "tx", "text").join(lists, ["id", "tx"]).groupBy("id", "tx").agg(F.first("w").alias("w"), F.first("text").alias("text"))
    stretches = scratch.keep(_stretches(texts))

    core = W.partitionBy("gram", "core")
    judged = _blocks(stretches).withColumn("core_n", F.sum("n").over(core)).where("core_n > 1")
    judged = judged.withColumn("sure", F.col("full") & (F.sum("n").over(W.partitionBy("gram", "core", "hull", "full")) > 1))
    judged = judged.withColumn("open", F.max(~F.col("sure") & F.exists("refs", lambda r: r["n"] == 1)).over(core))
    judged = scratch.keep(judged.select("gram", "sure", "open", F.explode("refs").alias("r")).select("gram", "r.*", "sure", "open"))
    look = judged.where("open").groupBy("gram", "whole").agg(F.collect_list("block").alias("blocks"))
    windows = _windows(stretches.join(look, ["gram", "whole"]).select("gram", "n", "id", "tx", "lo", "count", "off", "bytes", "blocks"))
    twice = windows.withColumn("times", F.sum("n").over(W.partitionBy("gram", "name"))).where("times > 1")
    single = twice.select(F.explode("places").alias("p")).select("p.*", F.lit(1).cast("long").alias("count"))

    place = stretches.where("n = 1").select("gram", "whole", "id", "tx", "lo", "off")
    sure = judged.where("n = 1 and sure").join(place, ["gram", "whole"]).select("id", "tx", (F.col("lo") + F.col("off") - F.col("block") * BLOCK - (BLOCK - 1)).alias("lo"), F.lit(BLOCK).cast("long").alias("count"))
    whole = known.where("n > 1").select("count", F.explode("places").alias("p")).select("p.*", "count")
    runs = written(whole.unionByName(sure).unionByName(single).groupBy("id", "tx").agg(F.sort_array(F.collect_set(F.struct("lo", "count"))).alias("runs")))
    scratch.drop()
    return runs


def _cut(rows: DataFrame, output: T.StructType, make) -> DataFrame:
    """Apply ``make(batch, kept texts as bytes, removed, spans)`` to rows whose last columns are text and runs."""

    def task(batches):
        for batch in batches:
            texts, runs = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("runs"))
            kept, removed, spans = [], [], []
            for i in range(batch.num_rows):
                raw, found = texts[i].as_py().encode(), runs[i].as_py()
                parts, done, gone, count = [], 0, 0, 0
                for r in found or ():
                    a, b = r["lo"], r["lo"] + r["count"] - 1 + LENGTH
                    if count == 0 or a > done:
                        parts.append(raw[done:a])
                        count += 1
                        gone += b - a
                    else:
                        gone += max(0, b - done)
                    done = max(done, b)
                kept.append(b"".join([*parts, raw[done:]]))
                removed.append(gone)
                spans.append(count)
            yield make(batch, kept, removed, spans)

    return rows.mapInArrow(task, output)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each document.

    Texts are UTF-8 bytes, null is empty; texts of fewer than LENGTH bytes lose nothing. Each row is a document, so rows that repeat
    an id and a text remove each other. Ids may be null and of any type. Strings are judged on the input; other columns are
    ignored, and an empty table gives an empty table.
    """
    keyed = _keyed(docs)
    rows = keyed.join(repeated_windows(keyed), ["id", "tx"], "left").select("doc_id", "text", "runs")
    output = T.StructType([docs.schema["doc_id"], *_fields("n_bytes", "n_removed", "n_spans"), T.StructField("kept", T.BinaryType())])

    def make(batch, kept, removed, spans):
        sizes = [len(k) + r for k, r in zip(kept, removed, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=output.names)

    return _cut(rows, output, make)


def op8_substrings(spark, sf_dir):
    """Every whole text of ``documents``: what it loses to strings of 200 bytes that start elsewhere, too."""
    from .common import documents

    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same digests by comparing all windows; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out
