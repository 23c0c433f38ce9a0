"""Quality classifier: random-indexing word vectors, pooled per document, under a small numpy network.

Words are runs of letters, of digits or of other marks. Each word has a sparse index vector of +1 and -1 given by its
hash, and its word vector is the sum of the index vectors of its neighbours over *all* documents; words
are hashed into ``BUCKETS`` rows, so the table of vectors has a fixed size whatever the corpus. A document is
the mean and the spread of its words' vectors, how its neighbouring index vectors agree, and its mean index vector.

The network (one hidden layer) is fitted on at most ``MAX_LABELLED`` labelled rows, taken in the order of a hash of
the id; everything else covers all rows. A part of these rows is held back to fit the temperature of
the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 13, 32, 2, 2
#: Documented bound of the labelled sample; the model is fitted on no more rows.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 60, 256, 0.005

_KIND = np.full(256, 3, np.uint8)
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = 1
_KIND[list(b"0123456789")] = 2
_KIND[kernels.BLANK] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word; a run of one kind of marks counts by its kind and first bytes."""
    kind = _KIND[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.empty(n + 1, bool)
    new[0], new[1:n], new[n] = True, kind[1:] != kind[:-1], True
    new[offsets] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return kernels.span_hash(kernels.prefix_sums(data), starts, ends), kernels.text_index(starts, offsets)


def _index(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each nonzero of the words' index vectors."""
    out = []
    for k in range(NONZERO):
        part = hashes >> np.uint64(16 + 16 * k)
        out.append(((part & np.uint64(DIMENSIONS - 1)).astype(np.int64), ((part >> np.uint64(8)) & np.uint64(1)).astype(np.int64) * 2 - 1))
    return out


def count_contexts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
    """Add the texts' neighbours to ``table`` (BUCKETS * DIMENSIONS integers)."""
    hashes, owner = tokens(data, offsets)
    row = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64) * DIMENSIONS
    index = _index(hashes)
    for reach in range(1, REACH + 1):
        same = owner[reach:] == owner[:-reach]
        for word, other in ((slice(None, -reach), slice(reach, None)), (slice(reach, None), slice(None, -reach))):
            for at, sign in index:
                place = (row[word] + at[other])[same]
                table += np.bincount(place, weights=sign[other][same], minlength=len(table)).astype(np.int64)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text; zero for a text without words."""
    n = len(offsets) - 1
    hashes, owner = tokens(data, offsets)
    out = np.zeros((n, 3 * DIMENSIONS + 2), np.float32)
    if not len(hashes):
        return out
    counts = np.bincount(owner, minlength=n)
    full = np.flatnonzero(counts)
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = counts[full].astype(np.float64)
    row = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    for d in range(DIMENSIONS):
        own = vectors[:, d][row]
        mean = np.add.reduceat(own, begin, dtype=np.float64) / size
        out[full, d] = mean
        out[full, DIMENSIONS + d] = np.sqrt(np.maximum(0, np.add.reduceat(own * own, begin, dtype=np.float64) / size - mean * mean))
    index = _index(hashes)
    for at, sign in index:
        pooled = np.bincount(owner * DIMENSIONS + at, weights=sign, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
        out[full, 2 * DIMENSIONS : 3 * DIMENSIONS] += pooled[full] / size[:, None]
    agree = np.zeros(len(hashes))
    for step in (1, 2):  # neighbouring words whose index vectors agree
        for at, sign in index:
            agree[step:] += ((at[step:] == at[:-step]) & (sign[step:] == sign[:-step]) & (owner[step:] == owner[:-step])) / step
    out[full, -2] = np.add.reduceat(agree, begin) / size
    out[full, -1] = np.log1p(size)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The (BUCKETS, DIMENSIONS) table over all documents: centred rows of length one."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(f"v{d}", T.LongType()) for d in range(DIMENSIONS)])

    def task(batches):
        table = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        for _, data, offsets in kernels.slices(batches):
            count_contexts(data, offsets, table)
        table = table.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))] + [pa.array(table[used, d]) for d in range(DIMENSIONS)], names=schema.names)

    summed = docs.select("text").mapInArrow(task, schema).groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMENSIONS)])
    rows = summed.toArrow()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMENSIONS))
    if rows.num_rows:
        table[rows["bucket"].to_numpy()] = np.stack([rows[f"v{d}"].to_numpy() for d in range(DIMENSIONS)], axis=1)
    table = np.sign(table) * np.log1p(np.abs(table))
    table -= table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class Network:
    """Two layers of weights, the scaling of the input and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the log loss; a tenth of the rows is held back for the temperature.

    With no rows, or of one class only, every score is the share of label 1 (a half without rows), drawn a little to a half.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    x = x.astype(np.float64)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 10], order[len(x) // 10 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x - mean) / scale
    weights = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            a = z[part]
            h = np.maximum(0, a @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, weights[2]) * (h > 0)
            step += 1
            for w, g, (m, v) in zip(weights, (a.T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ error + 1e-4 * weights[2], np.array([error.sum()])), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if len(held):
        logits = model.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Word vectors over all documents, the network on labelled ones whose fold is not 1.

    Null labels and labels of documents that are not there are passed over; where rows repeat an id, its label is 1 if any says so.
    """
    vectors = word_vectors(docs)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("quality", T.DoubleType()), T.StructField("features", T.BinaryType())])

    def task(batches):
        for batch, data, offsets in kernels.slices(batches):
            x = pool(data, offsets, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=schema.names)

    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), "text")  # max_labelled small rows
    rows = labelled.mapInArrow(task, schema).toArrow()
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float32).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 3 * DIMENSIONS + 2), np.float32)
    y = rows["quality"].to_numpy() if rows.num_rows else np.zeros(0)
    order = np.lexsort((*x.T[:3], rows["doc_id"].to_numpy())) if rows.num_rows else []
    return Model(vectors, train(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about a megabyte: BUCKETS * DIMENSIONS numbers
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def task(batches):
        for batch, data, offsets in kernels.slices(batches):
            p = shared.value.network.probability(pool(data, offsets, shared.value.vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(task, schema)


def keep_good(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """The documents that score ``at_least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch, data, offsets in kernels.slices(batches):
            yield batch.filter(pa.array(shared.value.network.probability(pool(data, offsets, shared.value.vectors)) >= at_least))

    return docs.mapInArrow(task, docs.schema)


def op5_quality(spark, sf_dir):
    from .common import documents, table

    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
