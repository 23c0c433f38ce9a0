"""Winnowing fingerprints, in built-in functions only.

Every k-gram of code points is hashed; of each window of ``w`` consecutive hashes the least is selected, the rightmost if several
are equal. Two texts that share a passage of ``w + k - 1`` code points or more share a selected hash in it, and
the positions say where. A hash and its position are packed in one number so that the plain minimum is the
rule: the hash in the high 31 bits, ``2**32 - 1 - position`` in the low 32. The minimum over ``w`` (a power
of two) numbers takes ``log2(w)`` passes of pairwise minima.

The grams' hashes do not roll: a polynomial modulo a prime built up by doubling or fourfold over arrays took 1.4 and 1.9 times as long in built-in functions as
one hash of every gram, which is above the time that the check allows.

The fingerprint of a text with another end (``edited``) is put together from the fingerprints of the two texts;
only the windows across the seam are computed anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty

K, WINDOW = 16, 32
#: More than any array is long.
POSITION = (1 << 32) - 1
HASH = (1 << 31) - 1
#: Consecutive ids are dealt in ranges of about so many rows, each sorted by itself; the ranges are MOST_RANGES at most.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 16


def with_minima(df: DataFrame, text: str, out: str, k: int = K, w: int = WINDOW) -> DataFrame:
    """Add ``out``: the packed minimum of each window of ``text``.

    A text shorter than k has one gram, all of it; one of fewer than w grams has one window. An empty text has none.
    """
    df = df.withColumn("__g", F.expr(f"if({text} = '', cast(array() as array<string>), if(length({text}) < {k}, array({text}), regexp_extract_all({text}, r'(?s)(?=(.{{{k}}})).', 1)))"))
    df = df.withColumn("__m", F.expr(f"transform(__g, (x, i) -> shiftleft(xxhash64(x) & {HASH}L, 32) + {POSITION}L - i)")).drop("__g")
    df = df.withColumn("__n", F.size("__m"))
    step = 1
    while step < w:
        df = df.withColumn("__m", F.expr(f"zip_with(__m, slice(__m, {step} + 1, size(__m)), (a, b) -> least(a, b))"))
        step *= 2
    return df.withColumn(out, F.expr(f"slice(__m, 1, if(__n = 0, 0, greatest(1, __n - {w} + 1)))")).drop("__m", "__n")


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = WINDOW) -> DataFrame:
    return with_minima(df, text, out, k, w).withColumn(out, F.array_distinct(out))


def fingerprint_string(packed: str) -> str:
    """SQL for hash@position, comma-joined, in the order of the positions."""
    return f"array_join(transform({packed}, x -> concat(lower(hex(shiftright(x, 32))), '@', {POSITION}L - (x & {POSITION}L))), ',')"


def likeness(a: str, b: str) -> str:
    """SQL for the Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    ha, hb = (f"transform({x}, y -> shiftright(y, 32))" for x in (a, b))
    return f"if(size({a}) = 0 and size({b}) = 0, 1D, double(size(array_intersect({ha}, {hb}))) / greatest(1, size(array_union({ha}, {hb}))))"


def _buckets(docs: DataFrame, rows: int = RANGE_ROWS) -> str:
    """SQL for the group of an id: consecutive ranges of about ``rows`` rows each."""
    n = max(1, min(MOST_RANGES, docs.count() // rows))
    cuts = sorted(set(docs.agg(F.percentile_approx("__id", F.lit([i / n for i in range(1, n)]), max(20_000, 8 * n))).head()[0] or [])) if n > 1 else []
    if not cuts:
        return "0"
    fine = math.isqrt(len(cuts)) + 1  # a range is found by two short lists
    blocks = [cuts[i : i + fine] for i in range(0, len(cuts), fine)]
    heads = ", ".join(f"{b[0]}L" for b in blocks)
    inner = ", ".join("array(" + ", ".join(f"{c}L" for c in b) + ")" for b in blocks)
    coarse = f"size(filter(array({heads}), c -> c <= __id))"
    return f"if({coarse} = 0, 0, ({coarse} - 1) * {fine} + size(filter(get(array({inner}), {coarse} - 1), c -> c <= __id)))"


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, text, n_chars, print, edited, edited_print, next_print for each document.

    The edited text has the last quarter of the code points (rounded down) replaced by as many from the start of the next
    document in ascending doc_id, or all of it if it is shorter; the first follows the last. Null texts are empty,
    null ids come first, rows that repeat an id follow each other by text. Ids are whole numbers. Other columns are
    ignored, an empty table gives an empty table.

    The rows are dealt by ranges of ids, so the next document is in the same group but for the last of
    each; those get theirs from a table with one row for each range.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"))
    bucket = _buckets(base)
    base = base.withColumn("__bucket", F.expr(bucket))
    least = base.groupBy("__bucket").agg(F.min("__id").alias("__id"))
    first = base.join(F.broadcast(least.select("__id")), "__id").groupBy("__bucket", "__id").agg(F.min("text").alias("text"))  # a row for each range
    first = with_fingerprint(first, "text", "print", k, w)
    turn = W.orderBy("__bucket")  # a number for each range
    ring = least.select("__bucket", F.lead("__bucket").over(turn).alias("__n"), F.first("__bucket").over(turn).alias("__f")).select(F.col("__bucket").alias("__b"), F.coalesce("__n", "__f").alias("__to"))
    ring = ring.join(first.select(F.col("__bucket").alias("__to"), F.struct("text", "print").alias("__ring")), "__to").select("__b", "__ring")

    rows = base.repartition("__bucket").sortWithinPartitions("__bucket", "__id", "text")
    rows = with_fingerprint(rows, "text", "print", k, w)
    rows = rows.withColumn("__next", F.lead(F.struct("text", "print")).over(W.partitionBy("__bucket").orderBy("__id", "text")))
    rows = rows.join(ring, F.col("__bucket") == F.col("__b"), "left").withColumn("__next", F.coalesce("__next", "__ring"))
    rows = (
        rows.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("__p", (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
        .withColumn("__head", F.expr("left(__next.text, int(n_chars div 4))"))
        .withColumn("edited", F.expr("concat(left(text, __p), __head)"))
        .withColumn("__q", F.length("__head"))
        .withColumn("next_print", F.col("__next.print"))
    )
    # Windows that start before `a` lie within the kept part; those from `a` to the seam, and the first of the head, are in `__mid`.
    span = k + w - 1
    rows = rows.withColumn("__a", F.expr(f"greatest(0, __p - {span})")).withColumn("__long", F.expr(f"__p >= {span} and __q >= {span}"))
    rows = rows.withColumn("__mid", F.expr(f"if(__long, substring(edited, __a + 1, {2 * span}), if(__p >= {span}, substring(edited, __a + 1, {2 * span}), edited))"))
    rows = rows.withColumn("__last", F.expr(f"if(__long, right(__head, {span}), '')"))
    rows = with_minima(with_minima(rows, "__mid", "__mid_print", k, w), "__last", "__end", k, w)
    spot = f"({POSITION}L - (x & {POSITION}L))"
    rows = rows.withColumn("__mid_print", F.expr(f"if(__p >= {span}, transform(array_distinct(__mid_print), x -> x - __a), array_distinct(__mid_print))"))
    rows = rows.withColumn("__stop", F.expr(f"{POSITION}L - (get(__mid_print, 0) & {POSITION}L)"))
    rows = rows.withColumn("__end_at", F.expr(f"__q - {span} + {POSITION}L - (get(__end, 0) & {POSITION}L)"))
    kept = f"filter(print, x -> __p >= {span} and {spot} < __stop)"
    head = f"transform(filter(next_print, x -> __long and {spot} <= __end_at), x -> x - __p)"
    rows = rows.withColumn("edited_print", F.expr(f"array_distinct(concat({kept}, __mid_print, {head}))"))
    return rows.select("doc_id", "text", "n_chars", "print", "edited", "edited_print", "next_print")


def op9_fingerprints(spark, sf_dir):
    """Fingerprints of every whole text of ``documents``, of its edited text, and their likeness to each other and to the next one's."""
    from .common import documents

    rows = edited_fingerprints(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(fingerprint_string("print")).alias("fingerprint"),
        F.expr(fingerprint_string("edited_print")).alias("edited_fingerprint"), F.expr(likeness("print", "edited_print")).alias("near_edited"), F.expr(likeness("print", "next_print")).alias("near_next"),
    )
