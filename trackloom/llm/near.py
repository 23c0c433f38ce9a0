"""Near-duplicate documents: BagMinHash signatures, banding, exact verification, components.

A document is the bag of its five-word shingles. BagMinHash draws, for every shingle, a Poisson process over (time, weight)
whose points also name one of ``SIGNATURE`` registers; a register holds the time of its first point with a weight
below the shingle's count. The weights are discretised in blocks [0, 1), [1, 2), [2, 4), [4, 8) ..., each with a process of its own, so a
count of w costs the logarithm of w. Two registers agree with a probability equal to the weighted
Jaccard similarity. Points come in order of time, so a shingle is done when it passes the document's largest register.

Texts that are equal (by a 64-bit hash) are one node. ``BANDS`` bands of ``ROWS`` registers collide; each node is compared with the first node of its
buckets. Where a bucket then still holds several components, its members meet members of the two largest for a few rounds, and
at last all pairs of different components whose sketches agree well enough are compared. Links are
verified by the exact overlap of the bags; pairs within a component need no link of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import Scratch, checkpointed, id_key
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Recall of a pair at 0.8: 1 - (1 - 0.8 ** 5) ** 24 > 0.9999.
BANDS, ROWS = 24, 5
SIGNATURE = BANDS * ROWS
#: One bit of each register is kept. Two documents at 0.8 differ in 12 bits of 120 with a deviation of 3.3: in more than these by chance in 1 of 10,000 pairs.
MOST_DIFFER = 25
#: Rounds in which members of a bucket meet others of it before all pairs that are still apart do.
ROUNDS = 3


def bags(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count) of the texts' bags, by text."""
    starts, ends = kernels.words(data, offsets)
    hashes, owner = kernels.shingles(kernels.span_hash(kernels.prefix_sums(data), starts, ends), kernels.text_index(starts, offsets), k)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return owner[new], hashes[new], np.diff(np.append(new, len(hashes)))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, SIGNATURE) first times; infinite for a text without words."""
    out = np.full(n * SIGNATURE, np.inf)
    entries = [(owner, shingle, np.zeros(len(owner)), np.ones(len(owner)), count)]
    low = 1
    while (more := count > low).any():
        block = kernels.mix64(shingle[more] + np.uint64(low * 0xA0761D6478BD642F & (1 << 64) - 1))
        entries.append((owner[more], block, np.full(more.sum(), float(low)), np.full(more.sum(), float(low)), count[more]))
        low *= 2
    own, state, base, width, weight = (np.concatenate(x) for x in zip(*entries, strict=True))
    time = np.zeros(len(own))
    scale = 2.0**-53
    while len(own):
        state = kernels.mix64(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * scale) / width
        other = kernels.mix64(state ^ np.uint64(0xE7037ED1A0B428DB))
        hit = base + width * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32) < weight
        register = (other & np.uint64(0xFFFFFFFF)) % np.uint64(SIGNATURE)
        np.minimum.at(out, (own * SIGNATURE + register.astype(np.int64))[hit], time[hit])
        going = time < out.reshape(n, SIGNATURE).max(axis=1)[own]
        own, state, base, width, weight, time = own[going], state[going], base[going], width[going], weight[going], time[going]
    return out.reshape(n, SIGNATURE)


def weighted_registers(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have words, and their BagMinHash registers as (texts, SIGNATURE) whole numbers."""
    found = signatures(owner, shingle, count, n)
    full = np.flatnonzero(np.isfinite(found[:, 0]))
    return full, found[full].view(np.uint64)


class Sketching(NamedTuple):
    """How texts become bags and registers, how many of these make a band, from how many different bits on a pair is not compared, and the bits kept of each register."""

    bag: Callable = bags
    registers: Callable = weighted_registers
    bands: int = BANDS
    rows: int = ROWS
    most_differ: int = MOST_DIFFER
    bits: int = 1


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) keys."""
    bits = registers.reshape(len(registers), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), 1))
    for r in range(rows):
        key = kernels.mix64(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


SKETCH_SCHEMA = T.StructType([T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits0", T.LongType()), T.StructField("bits1", T.LongType())])


def sketch_batch(node: pa.Array, found: np.ndarray, how: Sketching) -> pa.RecordBatch:
    """The registers' band keys and bits as a batch of SKETCH_SCHEMA."""
    keys, half = band_keys(found, how.bands, how.rows), how.bands * how.rows * how.bits // 2
    mixed = kernels.mix64(found)
    bit = np.concatenate([mixed >> np.uint64(k) & np.uint64(1) for k in range(how.bits)], axis=1).reshape(len(found), 2, half)
    packed = (bit << np.arange(half, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, how.bands, dtype=np.int32), keys.ravel())
    return pa.RecordBatch.from_arrays([node, lists, pa.array(packed[:, 0].copy()), pa.array(packed[:, 1].copy())], names=SKETCH_SCHEMA.names)


def _sketches(docs: DataFrame, how: Sketching) -> DataFrame:
    """node, keys, bits0, bits1 (bits of each register) of every document that has words."""

    def task(batches):
        for batch, data, offsets in kernels.slices(batches):
            full, found = how.registers(*how.bag(data, offsets), batch.num_rows)
            yield sketch_batch(batch.column(0).take(pa.array(full)), found, how)

    return docs.select("node", "text").mapInArrow(task, SKETCH_SCHEMA)


def overlaps(texts_a: pa.Array, texts_b: pa.Array, bag=bags) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(texts_a)
    oa, sa, ca = bag(*kernels.text_bytes(texts_a))
    ob, sb, cb = bag(*kernels.text_bytes(texts_b))
    owner, shingle, count = np.concatenate((oa, ob)), np.concatenate((sa, sb)), np.concatenate((ca, cb))
    order = np.lexsort((shingle, owner))
    owner, shingle, count = owner[order], shingle[order], count[order]
    both = np.flatnonzero((owner[1:] == owner[:-1]) & (shingle[1:] == shingle[:-1]))
    common = np.bincount(owner[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
    total = np.bincount(owner, weights=count, minlength=n) - common
    return np.where(total > 0, common / np.maximum(total, 1), 0)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, bag=bags) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def task(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(overlaps(part.column(2), part.column(3), bag) >= similarity))

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(task, schema)


def _across(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, component of the buckets that hold several components."""
    own = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return checkpointed(own.join(mixed, "key").select("key", "node", "component"))


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after adding links; only the components that a link touches are worked on."""
    left, right = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    lifted = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(lifted, "a", "b")
    old = found.join(merged.withColumnRenamed("component", "new").withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return checkpointed(old.unionByName(merged).groupBy("node").agg(F.min("component").alias("component")))


def _sets(texts: DataFrame, bag=bags) -> DataFrame:
    """node, set: 32-bit hashes of the shingles, each numbered by its occurrence, so that the sets overlap as the bags do."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.ArrayType(T.IntegerType()))])

    def task(batches):
        for batch, data, offsets in kernels.slices(batches):
            owner, shingle, count = bag(data, offsets)
            row = np.repeat(np.arange(len(count)), count)
            turn = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count) if len(row) else row
            value = (kernels.mix64(shingle[row] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at = np.append(0, np.cumsum(np.bincount(owner[row], minlength=batch.num_rows))).astype(np.int32) if len(row) else np.zeros(batch.num_rows + 1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(value))], names=schema.names)

    return texts.select("node", "text").mapInArrow(task, schema)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, how: Sketching = Sketching()) -> DataFrame:
    """(node, component) of the texts that have a near duplicate; ``docs`` has node (a hash of the text) and text."""
    return classes_of(_sketches(docs, how), docs, similarity, rounds, how)


def classes_of(sketches: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, how: Sketching = Sketching()) -> DataFrame:
    """The same, of nodes whose sketches are given."""
    bag, scratch = how.bag, Scratch(docs.sparkSession)
    sketches = scratch.keep(sketches.dropDuplicates(["node"]))
    banded = sketches.select("node", F.explode("keys").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader")
    members = scratch.keep(banded.join(leaders, "key").select("key", "node", "leader"))
    tried = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    texts = scratch.keep(docs.join(members.select("node").distinct(), "node", "left_semi").select("node", "text").dropDuplicates(["node"]))
    found = components(_verified(tried, texts, similarity, bag), "a", "b")

    # The members outside a bucket's largest component meet members of it and of the second, other ones each round.
    for r in range(rounds):
        rest = _across(members, found)
        sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(r), "node").alias("h"), "node")).alias("one"))
        two = sizes.withColumn("nr", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "component"))).withColumn("largest", F.first("component").over(W.partitionBy("key").orderBy(F.desc("n"), "component"))).where("nr <= 2").select("key", "nr", "largest", F.col("component").alias("other"), F.col("one.node").alias("lead"))
        pairs = rest.join(two, "key").where("component <> other and (nr = 1 or component <> largest)").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
        links = checkpointed(_verified(pairs, texts, similarity, bag))
        if links.isEmpty():
            break
        found = _grown(found, links)

    # What is still apart is compared within the join on the key, by sketch and then by the sets of numbered shingles, so that only links come out.
    rest = _across(members, found).join(sketches.select("node", "bits0", "bits1"), "node").join(_sets(texts, bag), "node")
    a, b = (rest.select(F.col("key").alias(f"k{x}"), F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("bits0").alias(f"{x}0"), F.col("bits1").alias(f"{x}1"), F.col("set").alias(f"s{x}")) for x in "ab")
    differ = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    sizes = F.size("sa") + F.size("sb")
    alike = F.size(F.array_intersect("sa", "sb")) * (1 + similarity) >= similarity * sizes - 2
    apart = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (differ <= how.most_differ) & alike).select("a", "b").distinct()
    links = checkpointed(_verified(apart, texts, similarity, bag))
    found = found if links.isEmpty() else _grown(found, links)
    scratch.drop()
    return found


def with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, class_id (the least id of its class), class_size.

    Equal texts are one class, empty and null texts too; a text of fewer than five words is one shingle. Rows that repeat an id are
    separate documents of the same number; a null id is passed over in class_id unless the class has no other.
    Ids may be of any type. Other columns are ignored. Texts are read whole, however long. An empty table gives an empty table.
    """
    base = with_node(docs.select("doc_id", "text"))
    classes = near_classes(base.select("node", "text"), similarity)
    slim = base.select("doc_id", "node")
    nodes = slim.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = nodes.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = nodes.join(sums, "component").select("node", "class_id", "class_size")
    return slim.join(named, "node").select("doc_id", "class_id", "class_size")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns; of repeated rows one stays.

    Equal texts are one class, empty and null texts too. Null ids come last; ids may be of any type. An empty table gives an empty table.
    """
    base = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).withColumn("__id", id_key(docs))
    classes = near_classes(base.select(F.col("__node").alias("node"), "text"), similarity)
    # the choice is made over ids and nodes; of whole documents only those that stay are moved
    nodes = base.groupBy("__node").agg(F.min("__id").alias("__least")).join(classes.withColumnRenamed("node", "__node"), "__node", "left")
    stays = nodes.groupBy(F.coalesce("component", "__node").alias("__c")).agg(F.min(F.struct("__least", "__node")).alias("__first")).select("__first.__node", F.col("__first.__least").alias("__id"))
    kept = base.join(stays, ["__node", "__id"])
    nr = F.row_number().over(W.partitionBy("__node", "__id").orderBy(F.lit(0)))
    return kept.withColumn("__nr", nr).where("__nr = 1").select(*docs.columns)


def op2_near_duplicates(spark, sf_dir):
    """The class of near duplicates of every document."""
    from .common import documents

    return near_duplicates(documents(spark, sf_dir))
