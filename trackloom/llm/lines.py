"""Line dedup: repeated lines, and lines within a few edits of an earlier one, in built-in functions only.

Equal lines meet by two 64-bit hashes. For the edit join a line of L code points is cut in ``threshold + 1`` segments of even
length: if two lines are within the threshold, a segment of the shorter one stands unchanged in the longer one,
near its place. Each line is indexed under (segment number, length, segment) and looked up under the substrings
that the multi-match-aware rule leaves for every shorter length. Keys that only one line has are dropped by
an aggregation before anything is joined; the rest get their lines, and the join on the key itself verifies by the banded edit distance
with a threshold that Spark has built in, so that only true pairs come out. A bit-parallel distance in SQL functions gave the same results, but not
in the time allowed; see the README.

A line is removed where it occurs after its first occurrence, and everywhere if a line that occurs earlier is within the threshold.
"Earlier" is by id, then text, then line number. Lines are near within ``threshold`` edits if the shorter has ``MIN_CHARS`` characters or more;
shorter ones, where an edit is a large part, have no near lines but equal ones. Blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_key, text_or_empty

THRESHOLD, MIN_CHARS = 1, 32


def _keys(threshold: int, min_chars: int) -> str:
    """SQL for an array of (key, index) of ``line`` with length ``n``; index marks the line's own segments."""
    parts = []
    count = threshold + 1
    for delta in range(threshold + 1):
        size = f"(n - {delta})"
        for i in range(1, count + 1):
            start = f"(1 + {i - 1} * ({size} div {count}) + greatest(0, {i - 1} - ({count} - {size} % {count})))"
            length = f"({size} div {count} + if({i} > {count} - {size} % {count}, 1, 0))"
            for shift in range(max(1 - i, delta - (count - i)), min(i - 1, delta + (count - i)) + 1):
                own = delta == 0 and shift == 0
                parts.append(f"if({size} < {min_chars}, null, named_struct('key', xxhash64({i}, {size}, substring(line, {start} + {shift}, {length})), 'own', {str(own).lower()}))")
    return f"filter(array({', '.join(parts)}), k -> k is not null)"


def _with_key(docs: DataFrame) -> DataFrame:
    """doc (a hash of id and text) and rank (the id, null last) beside the text."""
    text = text_or_empty()
    return docs.withColumn("__text", text).withColumn("__doc", F.xxhash64("doc_id", text)).withColumn("__rank", id_key(docs))


def _occurrences(keyed: DataFrame) -> DataFrame:
    """A row for each line that is not blank."""
    return (
        keyed.select("__rank", "__doc", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
        .where("line rlike r'[^\\t-\\r\\x20]'")
        .withColumn("h", F.xxhash64("line"))
        .withColumn("g", F.xxhash64(F.lit(1), "line"))
    )


def removals(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """__doc, __removed (sorted line numbers from 0), __n_near (how many of them because of a near line) for documents that lose a line."""
    keyed = _with_key(docs)
    seen = _occurrences(keyed)
    # the filter keeps the two uses of this aggregation alike, so that its exchange is used twice
    lines = seen.groupBy("h", "g").agg(F.min(F.struct("__rank", "__doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 0")

    probes = seen.withColumn("n", F.length("line")).select("h", F.explode(F.expr(_keys(threshold, min_chars))).alias("k")).select("h", "k.key", "k.own")
    shared = probes.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("own").alias("own")).where("a <> b and own").select("key")
    met = checkpointed(probes.join(shared, "key").distinct())

    places = lines.join(met.select("h").distinct(), "h").select("h", "first")
    texts = (
        keyed.select("__doc", "__text")
        .join(places.groupBy("first.__doc").agg(F.collect_list(F.struct("h", "first")).alias("w")).select(F.col("__doc"), "w"), "__doc")
        .select(F.explode(F.expr("transform(w, x -> named_struct('h', x.h, 'first', x.first, 'line', get(split(__text, '\n', -1), x.first.pos)))")).alias("x"))
        .select("x.h", "x.first", "x.line").dropDuplicates(["h"])
    )
    full = met.join(texts, "h")
    a = full.where("own").select("key", F.col("h").alias("x"), F.col("first").alias("fx"), F.col("line").alias("lx"))
    b = full.select("key", F.col("h").alias("y"), F.col("first").alias("fy"), F.col("line").alias("ly"))
    near = a.join(b, "key").where(f"x <> y and (lx < ly or length(lx) <> length(ly)) and levenshtein(lx, ly, {threshold}) >= 0").select(F.expr("if(fx > fy, x, y)").alias("h")).distinct().withColumn("near", F.lit(True))

    decided = lines.join(near, "h", "left").where("n > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = seen.select("h", "g", "__rank", "__doc", "pos").join(decided, ["h", "g"]).where("near or first.__doc <> __doc or first.__rank <> __rank or first.pos <> pos")
    return gone.groupBy("__doc").agg(F.array_sort(F.collect_set("pos")).alias("__removed"), F.countDistinct(F.when(F.col("near"), F.col("pos"))).alias("__n_near"))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated and near-repeated lines; all columns stay, ``n_chars`` is counted anew if there.

    A null text stays null, an empty one empty. Rows that repeat an id and a text are treated alike; ids may be null (the last in order) and of any
    type. A document may become empty. Texts are read whole, however long. An empty table gives an empty table.
    """
    gone = removals(docs, threshold, min_chars)
    kept = F.expr("array_join(transform(filter(transform(split(__text, '\\n', -1), (l, i) -> named_struct('l', l, 'i', i)), x -> not array_contains(__removed, x.i)), x -> x.l), '\\n')")
    new = {"text": F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)}
    out = _with_key(docs).join(gone, "__doc", "left").withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op10_line_dedup(spark, sf_dir):
    """All documents: how many lines each has and loses, which (numbers from 0), and how many because of a near line."""
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts = _with_key(docs).select("doc_id", "__doc", F.size(F.split("__text", "\n", -1)).cast("long").alias("n_lines"))
    return counts.join(removals(docs), "__doc", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join("__removed", ","), F.lit("")).alias("removed")
    )
