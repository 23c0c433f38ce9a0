"""Personal data: patterns of fixed form, and identifiers that lexical patterns give away.

The fixed patterns find emails, IP addresses, payment cards and phone numbers. They seed a bootstrap. Instances are the known
entities, every other token with a digit or an at sign, and what a phone number that fails holds before one of its blanks. Lexical patterns of a
mention are the two words before it, the words around it, its shape (digits kept in number, runs of letters as one), and its shape with the word before.
Patterns and instances form a graph. In each round a pattern's confidence for a kind is the sum of its instances' scores over their
number, damped by ``DAMPING``; patterns with ``SUPPORT`` instances or more and a confidence of ``CONFIDENCE`` extract, and an
instance that they extract scores the noisy-or of them. Rounds go on until the extracting patterns stay the same; they can only become more.
Doubtful instances score nothing, so that doubt does not feed on itself. A mention is taken if a pattern extracts it or if its very instance is known elsewhere.

All of it is DataFrame work. The graph's tables are aggregated by pattern and by instance with map-side
combining, and the joins' keys may be hot: adaptive execution splits those partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty
from .spans import joined, labelled, with_matches

KINDS = ["email", "ip", "card", "phone"]
SUPPORT, CONFIDENCE, DAMPING = 4, 0.6, 2.0
#: More rounds than any graph met needs; a guard.
ROUNDS = 20

#: Fixed values of the contract. A match is extended to the left as far as it goes, so it starts at the previous match's end or after another character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A chain of digits begins where no digit, nor a digit and one separator, is before it; the bounds keep the matcher's recursion flat.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\t-\r\x20])[^\t-\r\x200-9@]*+[0-9@][^\t-\r\x20]*+"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LUHN = """(aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substring(d, length(d) - i + 1, 1)),
    2 * int(substring(d, length(d) - i + 1, 1)) - if(int(substring(d, length(d) - i + 1, 1)) > 4, 9, 0))) % 10 = 0)"""


_PHONE_OK = "length(regexp_replace(m.h, '[^0-9]', '')) between 9 and 15"
#: The ways to end a phone number early: 9 to 15 digits before a blank.
_PREFIXES = r"""flatten(transform(rejected, m -> transform(
    filter(transform(sequence(8, 14), d -> regexp_extract(m.h, concat(r'^(\+[0-9](?:[\x20().-]*+[0-9]){', d, r'})(?=\x20)'), 1)), x -> x <> ''),
    x -> named_struct('s', m.s, 'e', m.s + length(x), 'h', x, 'l', m.l, 'r', left(substring(m.h, length(x) + 1), 24)))))"""


def base_matches(docs: DataFrame) -> DataFrame:
    """Add an array column for each kind, and ``other``: tokens and ends of failed phone numbers that touch none of those."""
    df = docs.withColumn("__t", text_or_empty())
    df = with_matches(df, "email", EMAIL, "__t", gate="@")
    df = with_matches(df, "ip", IP, "__t", gate=".").withColumn("ip", F.expr(f"filter(ip, m -> m.h rlike r'^{_OCTET}(?:\\.{_OCTET}){{3}}$')"))
    df = with_matches(df, "card", CARD, "__t").withColumn(
        "card", F.expr(f"filter(card, m -> exists(array(translate(m.h, ' -', '')), d -> {_LUHN}))")
    )
    df = with_matches(df, "phone", PHONE, "__t", gate="+").withColumn("rejected", F.expr(f"filter(phone, m -> not ({_PHONE_OK}))")).withColumn("phone", F.expr(f"filter(phone, m -> {_PHONE_OK})"))
    df = with_matches(df, "other", CANDIDATE, "__t").withColumn("other", F.expr(f"concat(other, {_PREFIXES})")).drop("rejected")
    for kind in KINDS:
        df = df.withColumn("other", F.expr(f"filter(other, o -> not exists({kind}, m -> m.s < o.e and o.s < m.e))"))
    return df.drop("__t")


def _mentions(found: DataFrame) -> DataFrame:
    """(row, s, e, kind or null, instance, pattern): each mention under each of its patterns. Marks around an instance are not part of it."""
    parts = [f"transform({k}, m -> named_struct('kind', {i}, 'm', m))" for i, k in enumerate(KINDS)]
    mentions = found.select("__row", F.explode(F.expr(f"concat({', '.join(parts)}, transform(other, m -> named_struct('kind', cast(null as int), 'm', m)))")).alias("x"))
    bare = "lower(regexp_replace({}, r'[^\\p{{L}}]+', ''))"
    before = "slice(reverse(filter(split(x.m.l, r'[\\t-\\r\\x20]+'), w -> w <> '')), 1, 2)"
    after = "get(filter(split(x.m.r, r'[\\t-\\r\\x20]+'), w -> w <> ''), 0)"
    named = (
        mentions.withColumn("__before", F.expr(f"transform({before}, w -> {bare.format('w')})"))
        .withColumn("one", F.expr("coalesce(get(__before, 0), '')")).withColumn("two", F.expr("coalesce(get(__before, 1), '')"))
        .withColumn("next", F.expr(bare.format(f"coalesce({after}, '')")))
        .withColumn("__cut", F.expr("regexp_replace(x.m.h, r'^[^A-Za-z0-9+@(]+', '')"))
        .withColumn("instance", F.expr("regexp_replace(__cut, r'[^A-Za-z0-9)]+$', '')"))
        .withColumn("s", F.expr("x.m.s + length(x.m.h) - length(__cut)"))
        .withColumn("shape", F.expr("regexp_replace(regexp_replace(instance, '[0-9]', '9'), r'\\p{L}+', 'a')"))
    )
    patterns = """filter(array(
        if(one = '' or two = '', null, concat('l ', two, ' ', one)), if(one = '' or next = '', null, concat('b ', one, ' _ ', next)),
        concat('s ', shape), if(one = '', null, concat('x ', one, ' ', shape))), p -> p is not null)"""
    return named.where("instance <> ''").select("__row", "s", F.expr("s + length(instance)").alias("e"), F.col("x.kind").alias("kind"), "instance", F.explode(F.expr(patterns)).alias("pattern"))


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) of the patterns that extract, and (instance, kind) of the seeds."""
    edges = checkpointed(mentions.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    seeds = checkpointed(edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score")))
    # only patterns with enough instances, one seed among them at least, can ever extract; the rest of the graph falls away
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    live = checkpointed(edges.select("pattern", "instance").join(size, "pattern"))
    open_ = live.join(seeds.select("instance"), "instance", "left_anti").select("pattern", "instance")
    scores, patterns, before = seeds, None, -1
    for _ in range(rounds):
        sums = live.join(scores, "instance").groupBy("pattern", "kind").agg((F.sum("score") / (F.max("n") + F.lit(DAMPING))).alias("confidence"))
        patterns = checkpointed(sums.where(F.col("confidence") >= confidence))
        count = patterns.count()
        if count == before:
            break
        before = count
        drawn = open_.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        scores = seeds.unionByName(drawn)
    return patterns, seeds.select("instance", "kind")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id with the arrays of fixed matches, and ``found``: (s, k, e) of what patterns gave away, the longest of those at one place.

    Null and empty texts have no match. Rows that repeat an id are separate documents, a null id is kept; ids are of any type. Other columns
    are ignored. An empty table gives an empty table. Texts are read whole, however long; in one of many thousand matches the
    time grows with the square of their number.
    """
    texts = docs.select("doc_id", "text")
    found = checkpointed(base_matches(texts).drop("text").withColumn("__row", F.monotonically_increasing_id()))
    mentions = _mentions(found)
    extracting, seeds = bootstrap(mentions, rounds, support, confidence)
    unknown = mentions.where("kind is null").drop("kind")
    drawn = unknown.join(extracting, "pattern").select("__row", "s", "e", "kind", "confidence")
    known = unknown.select("__row", "s", "e", "instance").distinct().join(seeds, "instance").select("__row", "s", "e", "kind", F.lit(1.0).alias("confidence"))
    new = (
        drawn.unionByName(known).groupBy("__row", "s", "e").agg(F.expr("max_by(kind, struct(confidence, -kind))").alias("k"))
        .groupBy("__row").agg(F.expr("array_sort(collect_list(named_struct('s', s, 'k', k, 'e', e)))").alias("found"))
        .withColumn("found", F.expr("filter(found, f -> not exists(found, g -> g.s <= f.s and f.e <= g.e and g.e - g.s > f.e - f.s))"))
    )
    return found.join(new, "__row", "left").withColumn("found", F.expr("coalesce(found, cast(array() as array<struct<s:int,k:int,e:int>>))"))


def op3_personal_data(spark, sf_dir):
    """Personal data in every whole text of ``documents``; ``n_found`` spans come from the bootstrap."""
    from .common import documents

    found = find_personal_data(documents(spark, sf_dir)).withColumn("__base", F.expr(labelled(KINDS)))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.expr(joined("__base", KINDS)), 256).alias("base_sha256"),
        F.expr(joined("array_sort(concat(__base, found))", KINDS)).alias("spans"), F.size("found").cast("long").alias("n_found"),
    )
