"""Mix sources to target weights.

Every source's documents form one stream of words, in an order given by a hash. The stream may be
read up to ``max_epochs`` times, and is cut into blocks of ``block_words`` words; a source's target
is a number of words, so a whole number of blocks and a rest. A binary tree hands the blocks to the output
shards: each node gives half of its blocks to its left child, and how many of them come from each
source is a multivariate hypergeometric draw, so quotas add up exactly at every node. The leaves'
quotas then cut each source's permuted block sequence in disjoint ranges.

Only the source table (a row for each source) and the tree pass through single rows; the documents are
numbered within ``(source, bin)``, where the bin is a hash of the id, so a source that holds most
rows is spread over ``bins`` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: Each larger than any number of blocks met here; the first that does not divide it permutes the blocks.
PRIMES = (1_000_000_007, 998_244_353, 1_000_000_009)


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, LF, VT, FF and CR; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+")
    blank_edges = (parts[0] == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - blank_edges).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in code-point order, null last, take the weights in turn. Targets fill up like water:
    the excess of those above ``max_epochs`` times their size is shared again by weight.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    every = W.partitionBy(F.lit(1))
    fill = every.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("_total") - F.col("_cap_before")) / F.nullif(F.col("_weight_left"), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("_level", F.max(F.when(F.col("_ratio") > level, level)).over(every))
        .select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"))
    )


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL for a hypergeometric draw by inversion: of ``total`` balls ``good`` are good and ``n`` are taken.

    The pmf is walked by its ratio of neighbours over ten standard deviations around the mode.
    """
    return f"""
    element_at(transform(transform(array(named_struct('t', double({total}), 'g', double({good}), 'n', double({n}))),
      p -> named_struct('t', p.t, 'g', p.g, 'n', p.n,
        'm', floor((p.n + 1) * (p.g + 1) / (p.t + 2)),
        's', bigint(2 + ceil(10 * sqrt(greatest(0D, if(p.t > 1, p.n * (p.g / p.t) * (1 - p.g / p.t) * (p.t - p.n) / (p.t - 1), 0D))))))),
      p -> element_at(transform(array(named_struct(
          'a', greatest(0L, bigint(p.n + p.g - p.t), p.m - p.s), 'b', least(bigint(p.n), bigint(p.g), p.m + p.s))),
        r -> aggregate(sequence(r.a, r.b),
          named_struct('w', 1D, 'c', 0D, 'x', r.a,
            'goal', {u} * aggregate(sequence(r.a, r.b), named_struct('w', 1D, 'c', 0D),
              (z, x) -> named_struct('w', z.w * if(x = r.a, 1D, (p.g - x + 1) * (p.n - x + 1) / (x * (p.t - p.g - p.n + x))),
                                     'c', z.c + z.w * if(x = r.a, 1D, (p.g - x + 1) * (p.n - x + 1) / (x * (p.t - p.g - p.n + x)))),
              z -> z.c)),
          (z, x) -> named_struct('w', z.w * if(x = r.a, 1D, (p.g - x + 1) * (p.n - x + 1) / (x * (p.t - p.g - p.n + x))),
                                 'c', z.c + z.w * if(x = r.a, 1D, (p.g - x + 1) * (p.n - x + 1) / (x * (p.t - p.g - p.n + x))),
                                 'x', if(z.c < z.goal, x, z.x), 'goal', z.goal),
          z -> z.x)), 1)), 1)"""


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """One row with ``quotas`` (blocks of each source) -> one row for each of ``2 ** depth`` shards."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(depth):
        u = f"((xxhash64({seed}, {level}, node, i) & 4503599627370495L) + 0.5D) / 4503599627370496D"
        left = f"""
        aggregate(transform(quotas, (q, i) -> named_struct('q', q, 'u', {u})),
          named_struct('t', aggregate(quotas, 0L, (a, q) -> a + q), 'n', aggregate(quotas, 0L, (a, q) -> a + q) div 2, 'out', array_repeat(0L, 0)),
          (acc, e) -> element_at(transform(array({_draw("acc.t", "e.q", "acc.n", "e.u")}),
            k -> named_struct('t', acc.t - e.q, 'n', acc.n - k, 'out', array_append(acc.out, k))), 1),
          acc -> acc.out)"""
        nodes = nodes.withColumn("_left", F.expr(left)).select(
            F.explode(F.expr("array(named_struct('node', node * 2, 'quotas', _left), named_struct('node', node * 2 + 1, 'quotas', zip_with(quotas, _left, (a, b) -> a - b)))")).alias("c")
        ).select("c.*")
    return nodes


def mix(docs: DataFrame, block_words: int = 4096, depth: int = 6, bins: int = 1024, seed: int = 7, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``size, source_size, target, taken, pieces`` to every document.

    ``taken`` counts the words that the mix takes of it, repeats included, and ``pieces`` says where they go:
    structs of shard, bin and place (the order in which a shard is read: it is shuffled locally), block, epoch, first word and words.

    A null text has size 0 and a null id or source is a value like any other. Rows that repeat an id
    are separate documents; ids may be of any type. Texts are read whole. A source without words has target 0. An input column named like an
    output is replaced. An empty table gives an empty table.
    """
    out = ("size", "source_size", "target", "taken", "pieces")
    keep = [c for c in docs.columns if c not in out]
    base = docs.select(*keep, n_words(F.col("text")).alias("size"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(bins)).alias("__bin"))

    by_bin = base.groupBy("source", "__bin").agg(F.sum("size").alias("__words"))
    offsets = by_bin.select("source", "__bin", (F.coalesce(F.sum("__words").over(W.partitionBy("source").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("__offset"))
    plan = (
        source_targets(by_bin.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, max_epochs)
        .withColumn("__quota", F.floor(F.col("target") + 0.5))
        .withColumn("__blocks", F.ceil(F.col("__quota") / F.lit(block_words)))
        .withColumn("__nr", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    )
    tree = split_tree(plan.agg(F.expr("transform(array_sort(collect_list(struct(__nr, __blocks))), x -> x.__blocks)").alias("quotas")), depth, seed)
    leaves = tree.select("node", F.posexplode("quotas").alias("i", "q")).groupBy((F.col("i") + 1).alias("__nr")).agg(F.expr("transform(array_sort(collect_list(struct(node, q))), x -> x.q)").alias("__q"))
    ends = leaves.select("__nr", F.expr("transform(__q, (x, i) -> aggregate(slice(__q, 1, i + 1), 0L, (a, b) -> a + b))").alias("__ends"))
    where = offsets.join(plan.join(ends, "__nr"), offsets["source"].eqNullSafe(plan["source"]), "inner").select(offsets["source"].alias("__s"), F.col("__bin").alias("__b"), "__offset", "source_size", "target", "__quota", "__blocks", "__ends", "__nr")

    order = W.partitionBy("source", "__bin").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        base.withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .join(where, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
        .withColumn("__at", F.col("__offset") + F.col("__before"))
    )
    multiplier = F.expr(f"case when __blocks % {PRIMES[0]} != 0 then {PRIMES[0]}L when __blocks % {PRIMES[1]} != 0 then {PRIMES[1]}L else {PRIMES[2]}L end")
    shift = F.expr(f"pmod(xxhash64({seed}, __s), greatest(__blocks, 1))")
    pieces = f"""
    flatten(transform(filter(sequence(0L, {max_epochs - 1}L), e -> size > 0 and __at + e * source_size < __quota),
      e -> transform(sequence((__at + e * source_size) div {block_words}, (least(__at + e * source_size + size, __quota) - 1) div {block_words}),
        b -> named_struct(
          'shard', size(filter(__ends, x -> x <= pmod(__mult * b + __shift, __blocks))), 'block', b, 'epoch', int(e),
          'first_word', greatest(b * {block_words} - __at - e * source_size, 0L),
          'words', least((b + 1) * {block_words}, __at + e * source_size + size, __quota) - greatest(b * {block_words}, __at + e * source_size),
          'shuffle_key', xxhash64({seed}, doc_id, b)))))"""
    placed = placed.withColumn("__mult", multiplier).withColumn("__shift", shift).withColumn("pieces", F.expr(pieces)).withColumn("taken", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.words)"))
    return _shuffled(placed, bins).select(*keep, *out)


def _shuffled(placed: DataFrame, bins: int) -> DataFrame:
    """``pieces`` with bin and place: a shard is read bin by bin, each in the order of its places, which is that of the shuffle keys.

    A piece's row is known by its source and where it begins in it; only numbers are sorted, not texts.
    """
    local = W.partitionBy("p.shard", "bin").orderBy("p.shuffle_key", "__nr", "__at", "k")
    drawn = placed.select("__nr", "__at", F.posexplode("pieces").alias("k", "p")).withColumn("bin", F.pmod("p.shuffle_key", F.lit(bins)).cast("int"))
    drawn = drawn.withColumn("place", F.row_number().over(local)).groupBy("__nr", "__at").agg(F.array_sort(F.collect_list(F.struct("k", "bin", "place"))).alias("__places"))
    merged = F.expr("transform(pieces, (p, i) -> named_struct('shard', p.shard, 'bin', get(__places, i).bin, 'place', get(__places, i).place, 'block', p.block, 'epoch', p.epoch, 'first_word', p.first_word, 'words', p.words))")
    return placed.join(drawn, ["__nr", "__at"], "left").withColumn("pieces", merged)


#: SQL for the pieces of a document as text.
PIECES = "array_join(transform(pieces, p -> concat_ws(':', p.shard, p.bin, p.place, p.block, p.epoch, p.first_word, p.words)), ',')"


def op7_mix_sources(spark, sf_dir):
    """All documents with what the mix takes of each; ``shards`` lists shard:bin:place:block:epoch:first word:words of its pieces."""
    from .common import documents

    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.expr(PIECES).alias("shards"))
