"""Substring dedup: equal passages by content cuts; near paragraphs by MinHash banding, exact verification, components.

Repeated passages rarely begin and end with a line, so grams are placed by content: of each ``REACH`` consecutive word pairs the
one with the least hash starts a gram of ``GRAM`` words. Equal passages of ``REACH + GRAM - 1`` = 50 words or more, wherever they stand,
have the same grams: the first begins among their first ``REACH`` words, the last ends among their last ones, and between them no word is
left out, since cuts are at most ``REACH`` words apart. So each word of a passage that no gram covers is within ``EXTEND`` words of one of its grams, at a
gap between the text's repeated grams. All grams so near a gap are extended word by word towards it, as far as another occurrence of the same
gram has the same words. Thus every passage of 50 words or more is found to its ends.

Repeats and near repeats are also sought among the real paragraphs (``blocks``), whole: those of ``REPORTED`` words or more by default. One of fewer than eight
words has fewer than four five-word shingles and cannot differ at a similarity of 0.8. They are classed as documents are in ``near``, by
MinHash and exact Jaccard similarity, but over sets of shingles. The grams are the exact path beside it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, near
from .common import Scratch, id_key, text_or_empty, written

REACH, MIN_WORDS, SHINGLE, SIMILARITY = 20, 8, 5, 0.8
#: Least words of a real paragraph that the operator reports unless told otherwise: shorter lines repeat in texts that share nothing else, and are line dedup's matter.
REPORTED = 12
#: Words of the gram that starts at each cut. Equal passages of REACH + GRAM - 1 = 50 words share a cut among their first REACH words, so that gram.
GRAM = 31
#: Words by which a gram at a gap may grow; the outermost grams of an equal passage of 50 words or more leave fewer than REACH on either side.
EXTEND = REACH - 1
#: Longest paragraph that content cuts leave where a text has no lines; half of it on average.
BLOCK = 200
#: Recall of a pair at 0.8: 1 - (1 - 0.8 ** 3) ** 8 > 0.996.
BANDS, ROWS = 8, 3
#: A hash function each: shingles are mixed already, so that the high bits of their products by odd numbers are as good as drawn.
FACTORS = np.random.default_rng(1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """The words of many texts: start and end bytes, the text of each, hashes, the hashes' prefix sums, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends = kernels.words(data, offsets)
        hashes = kernels.span_hash(kernels.prefix_sums(data), starts, ends)
        return cls(starts, ends, kernels.text_index(starts, offsets), hashes, kernels.prefix_sums(hashes), np.searchsorted(starts, offsets[:-1]))

    def pairs(self) -> np.ndarray:
        return kernels.mix64(self.hashes * np.uint64(0x9E3779B97F4A7C15) + np.append(self.hashes[1:], np.uint64(0)))


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, hash) of the grams that start at content cuts, or at a text's first word, and fit in their text."""
    n = len(w.starts)
    if n < GRAM:
        return w.first[:0], w.first[:0], w.hashes[:0]
    cut = np.append(True, w.owner[1:] != w.owner[:-1])
    inside = w.owner[: n - REACH + 1] == w.owner[REACH - 1 :]
    cut[np.unique(kernels.least_at(w.pairs(), REACH)[inside])] = True
    a = np.flatnonzero(cut)
    a = a[a + GRAM <= np.append(w.first[1:], n)[w.owner[a]]]
    return a, a + GRAM, kernels.span_hash(w.sums, a, a + GRAM)


def real_paragraphs(data: np.ndarray, w: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, hash) of the real paragraphs of ``min_words`` words or more, in order.

    Paragraphs are parted by blank lines, in a text without blank lines by line ends. A text without either, and also
    what lies within a paragraph of more than ``2 * BLOCK`` words, is cut by content, as above but over ``BLOCK`` words.
    """
    starts, owner, n = w.starts, w.owner, len(w.starts)
    if not n:
        return w.first[:0], w.first[:0], w.hashes
    lines = np.append(0, np.cumsum(data == 10))
    new = np.append(True, owner[1:] != owner[:-1])
    gap = np.where(new, 0, lines[starts] - lines[np.append(0, w.ends[:-1])])
    most = np.zeros(len(w.first), np.int64)
    np.maximum.at(most, owner, gap)
    edge = np.append(new | (gap >= 1) & (gap >= np.minimum(most[owner], 2)), True)
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    bare, long = most[owner[a]] == 0, b - a > 2 * BLOCK
    if n >= BLOCK and (bare | long).any():
        group = np.cumsum(edge[:-1])
        inside = (group[: n - BLOCK + 1] == group[BLOCK - 1 :]) & np.repeat(bare | long, b - a)[: n - BLOCK + 1]
        edge[np.unique(kernels.least_at(w.pairs(), BLOCK)[inside])] = True
        whole = ~bare | (np.add.reduceat(edge[:-1].astype(np.int64), a) == 1)
        a, b = a[whole], b[whole]
        at = np.flatnonzero(edge)
        part = ~np.isin(at[:-1], a) | ~np.isin(at[1:], b)
        a, b = np.concatenate((a, at[:-1][part])), np.concatenate((b, at[1:][part]))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    enough = b - a >= min_words
    a, b = a[enough], b[enough]
    return a, b, kernels.mix64(kernels.span_hash(w.sums, a, b) + np.uint64(1))


def blocks(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS):
    """(text, start byte, end byte, hash, first word, end word) of the real paragraphs, and each text's first word."""
    w = Words.of(data, offsets)
    a, b, unit = real_paragraphs(data, w, min_words)
    return w.owner[a], w.starts[a], w.ends[b - 1], unit, a, b, w.first


def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the spans [a, b), which may overlap, and the span of each place."""
    size = b - a
    whose = np.repeat(np.arange(len(a)), size)
    return np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size) + a[whose], whose


def min_hashes(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have words, and their least hashes of BANDS * ROWS functions."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    out = np.empty((len(first), len(FACTORS)), np.uint64)
    if len(first):
        for r, factor in enumerate(FACTORS):
            out[:, r] = np.minimum.reduceat(shingle * factor, first)
    return owner[first], out


def shingle_set(data: np.ndarray, offsets: np.ndarray):
    """The texts' bags with every count one, so that similarities are those of sets."""
    owner, shingle, count = near.bags(data, offsets)
    return owner, shingle, np.ones_like(count)


#: At a similarity of 0.8 a pair differs in 5 of 48 bits on average: in more than 15 by chance in fewer than 1 of 100,000 pairs.
SKETCHING = near.Sketching(shingle_set, min_hashes, BANDS, ROWS, 15, bits=2)


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc"), text.alias("text"))


def _units(keyed: DataFrame, min_words: int) -> DataFrame:
    """A row for each gram and for each real paragraph."""
    schema = T.StructType([keyed.schema["doc_id"], keyed.schema["doc"]] + [T.StructField(c, T.IntegerType()) for c in ("start", "end", "word", "words")] + [T.StructField("unit", T.LongType()), T.StructField("gram", T.BooleanType())])

    def task(batches):
        for batch, data, offsets in kernels.slices(batches, "text"):
            w = Words.of(data, offsets)
            exact = grams(w)
            a, b, unit = (np.concatenate(x) for x in zip(exact, real_paragraphs(data, w, min_words), strict=True))
            text = w.owner[a]
            at = pa.array(text)
            whole = (w.starts[a] - offsets[text], w.ends[b - 1] - offsets[text], a - w.first[text], b - a)
            columns = [batch.column(i).take(at) for i in range(2)] + [pa.array(x.astype(np.int32)) for x in whole]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(unit.view(np.int64)), pa.array(np.arange(len(a)) < len(exact[0]))], names=schema.names)

    return keyed.select("doc_id", "doc", "text").mapInArrow(task, schema)


def _sketches(keyed: DataFrame, min_words: int) -> DataFrame:
    """node and sketch of each real paragraph, straight from the documents."""

    def task(batches):
        for _, data, offsets in kernels.slices(batches, "text"):
            w = Words.of(data, offsets)
            a, b, unit = real_paragraphs(data, w, min_words)
            at, whose = spread(a, b)
            shingle, owner = kernels.shingles(w.hashes[at], whose, SHINGLE)
            full, found = min_hashes(owner, shingle, shingle, len(a))
            yield near.sketch_batch(pa.array(unit.view(np.int64)[full]), found, SKETCHING)

    return keyed.select("text").mapInArrow(task, near.SKETCH_SCHEMA)


def _blocks(keyed: DataFrame, min_words: int) -> DataFrame:
    """node, text of each real paragraph."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("text", T.StringType())])

    def task(batches):
        for _, data, offsets in kernels.slices(batches, "text"):
            _, start, end, unit, *_ = blocks(data, offsets, min_words)
            raw = pa.py_buffer(data[spread(start, end)[0]].tobytes())
            spans = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(0, np.cumsum(end - start)).astype(np.int32).tobytes()), raw)
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), spans], names=schema.names)

    return keyed.select("text").mapInArrow(task, schema)


def _contexts(texts: DataFrame) -> DataFrame:
    """(doc, text, w: wanted grams) -> for each gram and side the hashes of the up to EXTEND words beside it, the nearest first; for grams at a gap (own) also the bytes of the text to which each of these words reaches."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("word", T.IntegerType()), T.StructField("unit", T.LongType()), T.StructField("left", T.BooleanType()), T.StructField("own", T.BooleanType()), T.StructField("beside", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def task(batches):
        for batch, data, offsets in kernels.slices(batches, "text"):
            w = Words.of(data, offsets)
            first = np.append(w.first, len(w.starts))
            wanted = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            place = wanted.flatten()
            get = lambda c: place.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            k = np.arange(EXTEND)
            for side in ("left", "right"):
                use = np.flatnonzero(get(side).astype(bool))
                unit, word, own, row = get("unit")[use], get("word")[use], get(f"own_{side}")[use].astype(bool), text[use]
                begin = first[row] + word
                at = begin[:, None] - 1 - k if side == "left" else begin[:, None] + GRAM + k
                inside = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
                at, whose = at[inside], np.repeat(np.arange(len(use)), inside.sum(axis=1))
                reach = (w.starts if side == "left" else w.ends)[at] - offsets[row[whose]]
                listed = lambda of, x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(whose[of], minlength=len(use)))).astype(np.int32)), pa.array(x[of]))  # noqa: B023, E731
                lists = [listed(np.ones(len(whose), bool), w.hashes[at].view(np.int64)), listed(own[whose], reach.astype(np.int32))]
                columns = [batch.column(0).take(pa.array(row)), pa.array(word.astype(np.int32)), pa.array(unit), pa.array(np.full(len(use), side == "left")), pa.array(own)]
                yield pa.RecordBatch.from_arrays(columns + lists, names=schema.names)

    return texts.select("doc", "text", "w").mapInArrow(task, schema).where("size(beside) > 0")


def _gaps(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each gram, in order of text and word, is within EXTEND words of a gap between grams (or of the text's end) on its left and right."""
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, bool)
    new = np.append(True, doc[1:] != doc[:-1])
    word = word.astype(np.int64)
    at = np.flatnonzero(new | np.append(True, word[1:] > word[:-1] + GRAM))
    size = np.diff(np.append(at, len(word)))
    begin, last = np.repeat(word[at], size), np.repeat(word[at + size - 1], size)
    return (word - begin < EXTEND) & (begin > 0), last - word < EXTEND


def _marked(repeated: DataFrame) -> DataFrame:
    """``repeated`` by text and word, with own_left and own_right: the grams that may grow."""
    schema = T.StructType(repeated.schema.fields + [T.StructField(c, T.BooleanType()) for c in ("own_left", "own_right")])

    def task(batches):
        def marks(t):
            gram = t.column("gram").to_numpy()
            for name, x in zip(schema.names[-2:], _gaps(t.column("doc").to_numpy()[gram], t.column("word").to_numpy()[gram]), strict=True):
                own = np.zeros(len(gram), bool)
                own[gram] = x
                t = t.append_column(name, pa.array(own))
            return t.to_batches()

        held = []  # rows of the last text seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc").to_numpy()
            change = np.flatnonzero(doc[1:] != doc[:-1])
            if held and held[0].column("doc")[0].as_py() != int(doc[0]):
                yield from marks(pa.Table.from_batches(held))
                held = []
            if len(change):
                k = int(change[-1]) + 1
                yield from marks(pa.Table.from_batches([*held, batch.slice(0, k)]))
                held, batch = [], batch.slice(k)
            held.append(batch)
        if held:
            yield from marks(pa.Table.from_batches(held))

    return repeated.repartition("doc").sortWithinPartitions("doc", "word").mapInArrow(task, schema)


def _grown(marked: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, word, and for each side by how many words the gram there grows (l, r) and to which byte (l_at, r_at); only grams that grow.

    Words beside a gram that stand beside another occurrence too are found by order: of all different contexts of a gram the one with the longest common start is next to it.
    """
    own = marked.where("own_left or own_right")
    edge = own.groupBy("unit").agg(F.max("own_left").alias("left"), F.max("own_right").alias("right"))
    flags = ("left", "right", "own_left", "own_right")
    places = marked.where("gram").select("doc", "word", "unit", "own_left", "own_right").join(edge, "unit").repartition("doc")
    places = places.groupBy("doc", "word", "unit").agg(*(F.max(c).alias(c) for c in flags)).groupBy("doc").agg(F.collect_list(F.struct("unit", "word", *flags)).alias("w"))
    contexts = scratch.keep(_contexts(keyed.select("doc", "text").join(places, "doc")))
    key = ["unit", "left", "beside"]
    order = W.partitionBy("unit", "left", F.col("beside")[0]).orderBy("beside")
    # the place of the first word that differs, or all of the shorter one
    common = lambda other: F.coalesce(F.array_position(F.zip_with("beside", other, lambda x, y: x.eqNullSafe(y)), False) - 1, F.lit(0))
    length = contexts.groupBy(*key).agg(F.count("*").alias("c")).withColumns({"before": F.lag("beside").over(order), "after": F.lead("beside").over(order)})
    length = length.withColumn("by", F.when(F.col("c") > 1, F.size("beside")).otherwise(F.greatest(common("before"), common("after"))).cast("int")).where("by > 0").select(*key, "by")
    rows = contexts.where("own").join(length, key).select("doc", "word", "left", F.struct("by", F.element_at("at", F.col("by")).alias("at")).alias("x"))
    sides = rows.groupBy("doc", "word").agg(F.max(F.when(F.col("left"), F.col("x"))).alias("l"), F.max(F.when(~F.col("left"), F.col("x"))).alias("r"))
    return sides.select("doc", "word", F.col("l.by").alias("l"), F.col("l.at").alias("l_at"), F.col("r.by").alias("r"), F.col("r.at").alias("r_at"))


def paragraph_classes(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = REPORTED) -> DataFrame:
    """A row for each gram or real paragraph that has an equal or near one: doc_id, doc, start, end, words, unit, class, class_size, removed, grown_left, grown_right.

    Every member of a class has a row. start and end are bytes of the UTF-8 text; grams at a gap are extended, by the bytes in grown_left and grown_right. ``removed`` is false for the first of
    each class (by id, null last, then text and place). The words of all rows of a text hold those of every passage of 50 words or more that occurs again anywhere, the same text included.
    ``min_words`` is the least size of a real paragraph, 1 or more; one of fewer than five words has only equals.
    Null, empty and short texts have no paragraph; rows that repeat an id and a text have the same places twice. Ids may be of any type. Other columns
    are ignored. Texts are read whole, however long. An empty table gives an empty table.
    """
    keyed = _keyed(docs)
    # one node for each text of a paragraph, its words parted by whatever blanks
    found = near.classes_of(_sketches(keyed, min_words), _blocks(keyed, min_words), similarity, how=SKETCHING).select(F.col("node").alias("unit"), "component")
    every = _units(keyed, min_words)
    scratch = Scratch(docs.sparkSession)
    rank = id_key(every)
    units = every.groupBy("unit").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("rank"), "doc", "start")).alias("first"))
    units = scratch.keep(units.join(found, "unit", "left").where("n > 1 or component is not null"))
    classes = units.where("component is not null").groupBy("component").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    kept = units.where("component is not null").select("unit", "component").join(classes, "component").select("unit", F.col("component").alias("class"), "class_size", "first")
    kept = kept.unionByName(units.where("component is null").select("unit", F.col("unit").alias("class"), F.col("n").alias("class_size"), "first"))
    same = (F.col("first.rank") == rank) & (F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start"))
    marked = written(_marked(every.join(kept, "unit").withColumn("removed", ~same).drop("first")))
    scratch.drop()
    grown = written(_grown(marked, keyed, scratch))
    scratch.drop()
    own = F.col("own_left") | F.col("own_right")
    out = marked.where(~own).unionByName(marked.where(own).join(grown, ["doc", "word"], "left"), allowMissingColumns=True)
    left, right = (F.col("own_left") & F.col("l").isNotNull()), (F.col("own_right") & F.col("r").isNotNull())
    start, end = F.when(left, F.col("l_at")).otherwise(F.col("start")), F.when(right, F.col("r_at")).otherwise(F.col("end"))
    more = F.when(left, F.col("l")).otherwise(0) + F.when(right, F.col("r")).otherwise(0)
    places = {"grown_left": F.col("start") - start, "grown_right": end - F.col("end"), "start": start, "end": end, "words": F.col("words") + F.when(F.col("gram"), more).otherwise(0)}
    out = out.select("doc_id", "doc", "unit", "class", "class_size", "removed", *(x.cast("long").alias(c) for c, x in places.items()))
    return out.select("doc_id", "doc", "start", "end", "words", "unit", "class", "class_size", "removed", "grown_left", "grown_right")


def op1_passages(spark, sf_dir):
    """Every gram and real paragraph of all documents that is in a class of two or more."""
    from .common import documents

    return paragraph_classes(documents(spark, sf_dir)).select("doc_id", "start", "end", "words", F.col("class").alias("class_id"), "class_size", "removed")
