"""Hard negatives from vectors: ball trees by partition, searched by branch and bound.

Rows are dealt into parts of at most about ``PART_ROWS``, and each part becomes one ball tree, built once and written as a row. Anchors are
dealt into blocks of about ``BLOCK_ROWS``; a task gets one tree and one block, whatever the numbers of rows and anchors. A node bounds the inner product of
an anchor q with all its rows from both sides, q.c - |q| r and q.c + |q| r (c its centre, r its radius), and knows whether it holds a label, and only that one. A node is
passed over if its upper bound is strictly below the current k-th score, if its bounds lie outside of the score window, or if its
labels rule it out. Each anchor's most promising leaf goes first, so that the k-th scores are high early. Bounds have a slack for rounding; scores are exact whole numbers.

The best of all parts are merged by a window over the anchor. Positives come first, since their scores are the windows of the negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
PART_ROWS, BLOCK_ROWS, LEAF = 1 << 15, 1 << 13, 256
#: Anchors whose scores are held at a time.
STRIP = 1024

_TREE = T.StructType([T.StructField("part", T.LongType()), T.StructField("wide", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("row", "vec_id", "label", "values", "span", "child", "centre", "radius", "bits", "only"))])
_HIT = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "slot", "row", "vec_id", "score")])


def vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number), vec_id, label, v: the rows that take part, components as floor(scale * x)."""
    whole = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").cast("long")
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.expr(f"transform(embedding, x -> cast(floor({scale}D * double(x)) as bigint))").alias("v"))


def _matrix(lists: pa.Array, wide: int) -> np.ndarray:
    """(rows, wide) of an array column; shorter rows are filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), wide), np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)] = lists.flatten().to_numpy()
    return out


class Tree:
    """A ball tree over whole-number vectors; within a leaf rows are sorted by vec_id."""

    def __init__(self, row, vec_id, label, values, span, child, centre, radius, bits, only) -> None:
        self.row, self.vec_id, self.label, self.values = row, vec_id, label, values
        self.span, self.child, self.centre, self.radius, self.bits, self.only = span, child, centre, radius, bits, only

    @classmethod
    def build(cls, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, values: np.ndarray, leaf: int = LEAF) -> Tree:
        """Each node is cut at the median of its rows along the line between two far ones; equal rows are cut by number, so its depth is logarithmic."""
        order, span, child = np.arange(len(row)), [], []
        work = [(0, len(row))]
        points = values.astype(np.float64)
        while work:  # nodes in the order in which they are listed; children are listed later
            nxt = []
            for a, b in work:
                own = order[a:b]
                span.append((a, b))
                if b - a <= leaf:
                    order[a:b] = own[np.argsort(vec_id[own], kind="stable")]
                    child.append(-1)
                    continue
                x = points[own]
                far = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
                other = x[np.argmax(((x - far) ** 2).sum(axis=1))]
                half = (b - a) // 2
                order[a:b] = own[np.argpartition(x @ (other - far), half)]
                child.append(len(nxt))
                nxt += [(a, a + half), (a + half, b)]
            base = len(span)
            child[base - len(work) :] = [c if c < 0 else base + c for c in child[base - len(work) :]]
            work = nxt
        points, label = points[order], label[order]
        centre = np.array([points[a:b].mean(axis=0) for a, b in span])
        radius = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(span, centre, strict=True)])
        bits = np.array([np.bitwise_or.reduce(np.uint64(1) << (label[a:b] % 64).astype(np.uint64)) for a, b in span], np.uint64)
        only = np.array([(label[a:b] == label[a]).all() for a, b in span])
        return cls(row[order], vec_id[order], label, values[order], np.array(span, np.int64), np.array(child, np.int64), centre, radius, bits, only)

    def search(self, row: np.ndarray, label: np.ndarray, q: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best rows for every anchor and window: (anchors, windows, k), -1 where there are none.

        ``low`` and ``high`` are (anchors, windows). Rows have the anchor's label and are not the anchor itself (``same``), or have another label.
        """
        wide = self.values.shape[1]
        small = float(np.abs(q).max(initial=0)) * float(np.abs(self.values).max(initial=0)) * max(1, wide)
        if small >= 2.0**63:
            raise ValueError("scores do not fit in 64 bits")
        exact = np.float64 if small < 2.0**52 else np.int64
        points, anchors, norm = self.values.astype(exact), q.astype(exact), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        n, windows = low.shape
        best = np.full((n, windows, k), -np.inf if exact is np.float64 else np.iinfo(np.int64).min, exact)
        none = best.flat[0] if best.size else 0
        place = np.full((n, windows, k), -1, np.int64)
        mark = np.uint64(1) << (label % 64).astype(np.uint64)
        slack = 1e-9 * (norm * (np.sqrt((self.centre**2).sum(axis=1)).max(initial=0) + self.radius.max(initial=0))) + 1e-6

        def bounds(node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, reach = q[who] @ self.centre[node], norm[who] * self.radius[node] + slack[who]
            return at - reach, at + reach

        def wanted(node: int, who: np.ndarray) -> np.ndarray:
            """Of the anchors ``who``, those for which the node may hold a row."""
            fits = (self.bits[node] & mark[who]) != 0 if same else ~(self.only[node] & (label[who] == self.label[self.span[node][0]]))
            who = who[fits]
            least, most = bounds(node, who)
            open_ = (most[:, None] >= low[who]) & (least[:, None] <= high[who]) & (most[:, None] >= best[who, :, k - 1])
            return who[open_.any(axis=1)]

        def look(node: int, who: np.ndarray) -> None:
            a, b = self.span[node]
            for at in range(0, len(who), STRIP):
                own = who[at : at + STRIP]
                scores = anchors[own] @ points[a:b].T
                fits = (self.label[a:b][None, :] == label[own][:, None]) == same
                if same:
                    fits &= self.row[a:b][None, :] != row[own][:, None]
                for w in range(windows):
                    held = np.where(fits & (scores >= low[own, w, None]) & (scores <= high[own, w, None]), scores, none)
                    rows = np.flatnonzero((held >= best[own, w, k - 1, None]).any(axis=1) & (held.max(axis=1) > none))
                    if not len(rows):
                        continue
                    held, who_w = held[rows], own[rows]
                    new, spot = [], []
                    for _ in range(min(k, b - a)):  # the first of equal scores has the least vec_id
                        top = held.argmax(axis=1)
                        new.append(held[np.arange(len(rows)), top])
                        spot.append(np.where(new[-1] > none, a + top, -1))
                        held[np.arange(len(rows)), top] = none
                    score = np.concatenate([best[who_w, w], np.stack(new, axis=1)], axis=1)
                    where = np.concatenate([place[who_w, w], np.stack(spot, axis=1)], axis=1)
                    names = np.where(where >= 0, self.vec_id[where], np.iinfo(np.int64).max)
                    by_id = np.argsort(names, axis=1, kind="stable")
                    by = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(score, by_id, 1) if exact is np.float64 else ~np.take_along_axis(score, by_id, 1), axis=1, kind="stable"), 1)[:, :k]
                    best[who_w, w], place[who_w, w] = np.take_along_axis(score, by, 1), np.take_along_axis(where, by, 1)

        leaves = np.flatnonzero(self.child < 0)
        seen = {int(x): np.zeros(0, np.int64) for x in leaves}
        if len(leaves) > 1 and n:
            upper = q @ self.centre[leaves].T + norm[:, None] * self.radius[leaves][None, :]
            first = leaves[upper.argmax(axis=1)]
            for leaf in np.unique(first):
                seen[int(leaf)] = np.flatnonzero(first == leaf)
                look(leaf, wanted(leaf, seen[int(leaf)]))
        work = [(0, np.arange(n))]
        while work:
            node, who = work.pop()
            who = wanted(node, who)
            if not len(who):
                continue
            if self.child[node] < 0:
                look(node, np.setdiff1d(who, seen[int(node)], assume_unique=True))
            else:
                work += [(self.child[node] + 1, who), (self.child[node], who)]
        return best, place


def _trees(rows: DataFrame, parts: int, leaf: int) -> DataFrame:
    """A tree for each part, its arrays as bytes."""

    def task(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held)
        row, vec_id, label = (own.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        lists = own.column("v").combine_chunks()
        wide = int(np.diff(lists.offsets.to_numpy()).max())
        tree = Tree.build(row, vec_id, label, _matrix(lists, wide), leaf)
        values = tree.values.astype(np.int16) if np.abs(tree.values).max(initial=0) < 1 << 15 else tree.values
        arrays = [tree.row, tree.vec_id, tree.label, values, tree.span, tree.child, tree.centre, tree.radius, tree.bits, tree.only]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([wide], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=_TREE.names)

    return rows.repartition(parts).mapInArrow(task, _TREE)


def _tree(own: pa.Table) -> Tree:
    held = {c: own.column(c)[0].as_py() for c in own.column_names}
    wide, n = held["wide"], len(held["row"]) // 8
    get = lambda c, kind, shape=-1: np.frombuffer(held[c], kind).reshape(shape)
    kind = np.int64 if len(held["values"]) == n * wide * 8 else np.int16
    return Tree(get("row", np.int64), get("vec_id", np.int64), get("label", np.int64), get("values", kind, (n, wide)).astype(np.int64), get("span", np.int64, (-1, 2)), get("child", np.int64), get("centre", np.float64, (-1, wide)), get("radius", np.float64), get("bits", np.uint64), get("only", np.bool_))


def _searched(trees: DataFrame, anchors: DataFrame, parts: int, blocks: int, k: int, same: bool) -> DataFrame:
    """anchor, slot, row, vec_id, score: the k best rows of each part for every anchor and window.

    ``anchors`` has row, label, v and windows, an array of (slot, low, high).
    """

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in _HIT.names})
        tree = _tree(left)
        lists = right.column("v").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        wide = max(int(size.max(initial=0)), tree.values.shape[1])
        if wide > tree.values.shape[1]:
            more = ((0, 0), (0, wide - tree.values.shape[1]))
            tree.values, tree.centre = np.pad(tree.values, more), np.pad(tree.centre, more)
        row, label, q = right.column("row").to_numpy(), right.column("label").to_numpy(), _matrix(lists, wide)
        windows = [w or [] for w in right.column("windows").to_pylist()]
        most = max(map(len, windows), default=0)
        ends = np.iinfo(np.int64)
        low, high = np.full((len(row), most), ends.max), np.full((len(row), most), ends.min)  # no score is in a window that is not there
        slot = np.zeros((len(row), most), np.int64)
        for i, w in enumerate(windows):
            for j, x in enumerate(w):
                slot[i, j], low[i, j], high[i, j] = x["slot"], ends.min if x["low"] is None else x["low"], ends.max if x["high"] is None else x["high"]
        best, place = tree.search(row, label, q, k, low, high, same)
        i, j, m = np.nonzero(place >= 0)
        at = place[i, j, m]
        return pa.table({"anchor": row[i], "slot": slot[i, j], "row": tree.row[at], "vec_id": tree.vec_id[at], "score": best[i, j, m].astype(np.int64)})

    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("part", "block", *_TREE.names[1:])
    right = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select("part", "block", "row", "label", "v", "windows")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(task, _HIT)


def hard_negatives(table: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``every`` divides; the score of a row is the inner product of the whole-number vectors. An anchor's positives are its first rows of the same
    label, for each of which the first rows of other labels with low * positive <= 100 * negative <= high * positive are its negatives; equal scores go by vec_id.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Vectors of other lengths are filled with zeros. Rows that
    repeat an id are separate rows of the same number. Scores that do not fit in 64 bits raise. Other columns are ignored. An empty table, or one
    without anchors, gives an empty table.
    """
    scratch = Scratch(table.sparkSession)
    rows = scratch.keep(vectors(table, scale))
    count, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).head()
    parts, blocks = max(1, -(-count // part_rows)), max(1, -(-asked // block_rows))
    trees = scratch.keep(_trees(rows, parts, leaf))
    anchors = scratch.keep(rows.where(F.col("vec_id") % every == 0))
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]

    whole = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    found = _searched(trees, anchors.withColumn("windows", whole), parts, blocks, positives, True)
    found = scratch.keep(found.withColumn("slot", F.row_number().over(W.partitionBy("anchor").orderBy(*order)).cast("long")).where(F.col("slot") <= positives))

    # scores are whole, so the window's ends are rounded inwards
    window = F.struct("slot", F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {low} / 100) as bigint)").alias("low"), F.expr(f"cast(floor(cast(score as decimal(20,0)) * {high} / 100) as bigint)").alias("high"))
    asked = found.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window).alias("windows"))  # no more than the positives
    hits = _searched(trees, anchors.join(asked, "row"), parts, blocks, negatives, False)
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "slot").orderBy(*order))).where(F.col("rank") <= negatives)
    named = hits.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = named.join(found.select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "slot"])
    out = written(named.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    scratch.drop()
    return out


SQL = """
with v as materialized (select row_number() over () as r, vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.r <> b.r),
p as (select * from (select *, row_number() over (partition by r order by score desc, vec_id) as nr from s where same) x where nr <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.r, p.nr order by s.score desc, s.vec_id) as rank
  from p join s on p.r = s.r and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""


def op11_negatives(spark, sf_dir):
    """The hard negatives of every anchor of ``embeddings``."""
    from .common import table

    return hard_negatives(table(spark, sf_dir, "embeddings"))
