"""Phrase collocations by hierarchical pair naming.

Texts are cut in blocks of about ``BLOCK_WORDS`` words; a block is an array of numbers, one for each word, with a mark between
pieces. A level turns the k-grams of the blocks into (k+1)-grams: two k-grams that are adjacent and both frequent are a pair, the block
counts its own pairs, and one exchange by the pair sums the counts of all blocks and gives the pair its global name, which is the
first place (block and number in it) where it stands; names are therefore exact, not hashes. A pair's two names are its pointers to the phrase
without the last and without the first word. All cuts of a phrase, and all phrases within it, are found by following
those. A block sees a pair once however often it holds it, so the commonest pair has a row for each block and no more.

Most pairs are rare, and a larger text has ever more frequent words that make them. So pairs are first counted by hash: each block sends the hashes of its pairs as packed bytes, a
range of hashes is summed over all blocks in a task, and a bit for each comes back. A pair whose hash falls short of the least number falls short itself and gets no row; the
others are counted exactly and named in a task for each range, whose arrays, too, come packed from the blocks and go back packed. There are twice as many hashes as words, or more, so this keeps its worth however large the text.

A phrase of k words occurs as often as needed only if both phrases of k - 1 words in it do, so nothing is lost by pairing frequent ones alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import Scratch, written

LEAST, LONGEST, COVERED, MOST = 30, 4, 80, 2000
#: Words of a block; what a task holds at a time.
BLOCK_WORDS = 1 << 22
#: A place is block * 2 ** 31 + number; a block is partition * 2 ** 12 + turn.
_NUMBERS, _TURNS = 31, 12
#: A task counts ranges of 2 ** 22 hashes.
_RANGE = 22

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_BETWEEN = _SEPARATOR.copy()
_BETWEEN[[9, 32]] = True

_FIRST = T.StructType([T.StructField("block", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("codes", T.BinaryType())])
def _schema(longs: str, binaries: str) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.LongType()) for c in longs.split()), *(T.StructField(c, T.BinaryType()) for c in binaries.split())])


_HASHED, _MASK = _schema("block part", "codes names gaps counts"), _schema("block part", "mask")
_PAIRS, _NAMED = _schema("block part first", "codes lefts rights counts"), _schema("block part id left right f", "codes ids")


def _packed(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data, kind) -> np.ndarray:
    data, size = memoryview(data), np.dtype(kind).itemsize
    length = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=length, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _table(schema: T.StructType, n: int, **columns) -> pa.Table:
    """``n`` rows with nulls in the other columns."""
    kinds = {f.name: f.type for f in _arrow(schema)}
    return pa.Table.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], schema=_arrow(schema))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words in lower case, the text of each, and whether a piece ends before it."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends = kernels.runs(~_BETWEEN[data], offsets)
    inside = np.flatnonzero(~_BETWEEN[data])
    at = np.append(0, np.cumsum(ends - starts))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes()))
    owner = kernels.text_index(starts, offsets)
    marks = np.append(0, np.cumsum(_SEPARATOR[data]))
    first = np.ones(len(starts), bool)
    if len(starts):
        first[1:] = (owner[1:] != owner[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])
    return words, owner, first


def _block(number: int, parts: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> list[pa.RecordBatch]:
    """A block's words (a row for each language and word) and its array of numbers (-1 between pieces)."""
    words = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
    langs = pa.chunked_array([p[1] for p in parts]).combine_chunks().dictionary_encode()
    first = np.concatenate([p[2] for p in parts])
    wide = len(words.dictionary)
    both = langs.indices.to_numpy().astype(np.int64) * wide + words.indices.to_numpy()
    if len(langs.dictionary) * wide <= 8 * max(len(both), 1 << 20):  # few languages: count in place, else sort
        n = np.bincount(both, minlength=1)
        kinds = np.flatnonzero(n)
        n, code = n[kinds], (np.cumsum(n > 0, dtype=np.int32) - 1)[both]
    else:
        kinds, code, n = np.unique(both, return_inverse=True, return_counts=True)
    codes = np.full(len(code) + int(first.sum()), -1, np.int32)
    codes[np.arange(len(code)) + np.cumsum(first)] = code
    columns = [pa.array(np.full(len(kinds), number)), pa.array(np.arange(len(kinds), dtype=np.int32)), langs.dictionary.take(pa.array(kinds // wide)).cast(pa.string()), words.dictionary.take(pa.array(kinds % wide)).cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64)), pa.nulls(len(kinds), pa.binary())]
    return [pa.RecordBatch.from_arrays(columns, names=_FIRST.names), _codes_row(number, codes, _FIRST)]


def _codes_row(number: int, codes: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    own = {"block": pa.array([number]), "codes": pa.array([_packed(codes.astype(np.int32))], pa.binary())}
    return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(1, kinds[f.dataType]) for f in schema], names=schema.names)


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    def task(batches):
        partition, turn, parts, held = TaskContext.get().partitionId(), 0, [], 0

        def out():
            if turn >= 1 << _TURNS or partition >= 1 << 63 - _NUMBERS - _TURNS:
                raise ValueError("more blocks than a place can name")
            return _block((partition << _TURNS) + turn, parts)

        for batch, data, offsets in kernels.slices(batches):
            words, owner, first = _words(data, offsets)
            if len(words):
                parts.append((words, pc.take(pc.fill_null(batch.column("lang"), "und"), pa.array(owner)), first))
                held += len(words)
            if held >= block_words:
                yield from out()
                turn, parts, held = turn + 1, [], 0
        if held:
            yield from out()
        parts.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(task, _FIRST)


def _named(found: DataFrame, keys: list[str], least: int) -> DataFrame:
    """block, code, keys, id, f of the rows whose key occurs ``least`` times or more in all blocks: one exchange by the key."""
    place = F.col("block") * (1 << _NUMBERS) + F.col("code")
    own = W.partitionBy(*keys)
    return found.where("codes is null").drop("codes").withColumn("f", F.sum("n").over(own)).withColumn("id", F.min(place).over(own)).where(F.col("f") >= least).select("block", "code", *keys, "id", "f")


def _adjacent(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two phrases are adjacent, and those pairs."""
    whole = (codes[:-1] >= 0) & (codes[1:] >= 0)
    pair = codes[:-1][whole].astype(np.int64)
    pair *= size
    pair += codes[1:][whole]
    return whole, pair


def _starts(pair: np.ndarray) -> np.ndarray:
    out = np.ones(len(pair), bool)
    np.not_equal(pair[1:], pair[:-1], out=out[1:])
    return out


def _hashes(kinds: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits of the names of each pair."""
    h = names[kinds // len(names)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += names[kinds % len(names)].astype(np.uint64)
    for odd, shift in ((0xBF58476D1CE4E5B9, 32), (0x94D049BB133111EB, 31)):
        h *= np.uint64(odd)
        h ^= h >> np.uint64(shift)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(64 - bits)


def _without_marks(codes: np.ndarray) -> np.ndarray:
    """One mark between pieces is enough."""
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] >= 0) | (codes[:-1] >= 0)
    return codes[kept]


def _hashed(blocks: DataFrame, named: DataFrame, least: int, bits: int) -> DataFrame:
    """A row for each block with its named phrases alone, and a row for each range of hashes: steps from hash to hash of its pairs, and counts up to ``least``."""
    small = np.min_scalar_type(least)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_HASHED, 0)
        number, codes = left.column("block")[0].as_py(), _unpacked(left.column("codes")[0].as_buffer(), np.int32)
        if "ids" in right.column_names:
            code, names = (np.concatenate([_unpacked(x.as_buffer(), kind) for x in right.column(c)]) for c, kind in (("codes", np.int32), ("ids", np.int64)))
        else:
            code, names = right.column("code").to_numpy(), right.column("id").to_numpy()
        top = int(max(codes.max(initial=-1), code.max()))
        times = np.bincount(codes[codes >= 0], minlength=top + 1)[code]
        order = np.lexsort((code, -times))  # small numbers for what is common
        code, names = code[order], names[order]
        at = np.full(top + 2, -1, np.int32)  # the last place is that of the mark, -1
        at[code] = np.arange(len(code))
        codes = _without_marks(at[codes])
        pair = np.sort(_adjacent(codes, len(names))[1])
        if not len(pair):
            return _table(_HASHED, 0)
        start = np.flatnonzero(_starts(pair))
        kinds, n = pair[start], np.diff(np.append(start, len(pair)))
        del pair, start, at, times
        h = _hashes(kinds, names, bits)
        order = np.argsort(h, kind="stable")
        h, n = h[order].astype(np.int64), np.minimum(n[order], least).astype(small)
        part, gap = h >> _RANGE, h & ((1 << _RANGE) - 1)
        first = np.flatnonzero(_starts(part))
        cuts = list(zip(first, np.append(first[1:], len(part)), strict=True))
        before = np.append(0, gap[:-1])
        before[first] = 0
        gap = (gap - before).astype(np.uint32)
        own = _table(_HASHED, 1, block=[number], codes=[_packed(codes)], names=[_packed(names.astype(np.int64))])
        parts = _table(_HASHED, len(first), block=np.full(len(first), number), part=part[first], gaps=[_packed(gap[i:j]) for i, j in cuts], counts=[_packed(n[i:j]) for i, j in cuts])
        return pa.concat_tables([own, parts])

    return blocks.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(task, _HASHED)


def _masks(hashed: DataFrame, least: int) -> DataFrame:
    """block, part, mask: a bit for each of the block's pairs in the range, whether its hash comes ``least`` times or more in all blocks."""
    small = np.min_scalar_type(least)

    def task(rows: pa.Table) -> pa.Table:
        places = [np.cumsum(_unpacked(x.as_buffer(), np.uint32), dtype=np.int64) for x in rows.column("gaps")]
        counts = np.concatenate([_unpacked(x.as_buffer(), small) for x in rows.column("counts")])
        often = np.bincount(np.concatenate(places), weights=counts, minlength=1) >= least
        return _table(_MASK, len(places), block=rows.column("block").to_numpy(), part=rows.column("part").to_numpy(), mask=[np.packbits(often[p]).tobytes() for p in places])

    return hashed.where("part is not null").select("block", "part", "gaps", "counts").groupBy("part").applyInArrow(task, _MASK)


def _pairs(hashed: DataFrame, masks: DataFrame, bits: int) -> DataFrame:
    """A row for each block with its new array, and a row for each range with the block's pairs that may be frequent, in the order of their numbers from ``first`` on."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_PAIRS, 0)
        number = left.column("block")[0].as_py()
        codes, names = _unpacked(left.column("codes")[0].as_buffer(), np.int32), _unpacked(left.column("names")[0].as_buffer(), np.int64)
        whole, pair = _adjacent(codes, len(names))
        order = np.argsort(pair)
        pair = pair[order]
        start = _starts(pair)
        kinds, n = pair[start], np.diff(np.append(np.flatnonzero(start), len(pair)))
        del pair, codes
        new = np.empty(len(order), np.int32)
        new[order] = np.cumsum(start, dtype=np.int32) - 1
        del start
        h = _hashes(kinds, names, bits)
        order = np.argsort(h, kind="stable")
        part = (h[order] >> np.uint64(_RANGE)).astype(np.int64)
        del h
        sizes = np.diff(np.append(np.flatnonzero(_starts(part)), len(part)))
        masks = [np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=k) for m, k in zip(right.sort_by("part").column("mask"), sizes.tolist(), strict=True)]
        may = np.concatenate(masks).astype(bool)
        order, part = order[may], part[may]
        code = np.full(len(kinds), -1, np.int32)
        code[order] = np.arange(len(order))
        seq = np.full(len(whole), -1, np.int32)
        seq[whole] = code[new]
        kinds, n = kinds[order], n[order].astype(np.int64)
        first = np.flatnonzero(_starts(part))
        cuts = list(zip(first, np.append(first[1:], len(part)), strict=False))
        own = _table(_PAIRS, 1, block=[number], codes=[_packed(_without_marks(seq))])
        arrays = {"lefts": names[kinds // len(names)], "rights": names[kinds % len(names)], "counts": n}
        return pa.concat_tables([own, _table(_PAIRS, len(first), block=np.full(len(first), number), part=part[first], first=first, **{c: [_packed(x[i:j]) for i, j in cuts] for c, x in arrays.items()})])

    return hashed.where("part is null").select("block", "codes", "names").groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(task, _PAIRS)


def _named_pairs(found: DataFrame, least: int) -> DataFrame:
    """Of the pairs that occur ``least`` times or more in all blocks: a row each (id, left, right, f), and for the blocks (block, part) their numbers and ids."""

    def task(rows: pa.Table) -> pa.Table:
        left, right, n = ([_unpacked(x.as_buffer(), np.int64) for x in rows.column(c)] for c in ("lefts", "rights", "counts"))
        block, first = rows.column("block").to_numpy(), rows.column("first").to_numpy()
        sizes = [len(x) for x in n]
        ends = np.cumsum(sizes)
        code = np.concatenate([np.arange(f, f + k) for f, k in zip(first, sizes, strict=True)])
        place = np.repeat(block, sizes) * (1 << _NUMBERS) + code
        left, right, n = map(np.concatenate, (left, right, n))
        order = np.lexsort((right, left))
        start = _starts(left[order]) | _starts(right[order])
        at = np.flatnonzero(start)
        f, name = np.add.reduceat(n[order], at), np.minimum.reduceat(place[order], at)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(start) - 1
        whole = f >= least
        one = order[at[whole]]
        kept, names = whole[group], name[group]
        cuts = [(e - k, e) for e, k in zip(ends, sizes, strict=True)]
        some = [i for i, (a, e) in enumerate(cuts) if kept[a:e].any()]
        packed = {c: [_packed(x[a:e][kept[a:e]]) for a, e in (cuts[i] for i in some)] for c, x in (("codes", code.astype(np.int32)), ("ids", names))}
        pairs = _table(_NAMED, len(one), id=name[whole], left=left[one], right=right[one], f=f[whole])
        return pa.concat_tables([pairs, _table(_NAMED, len(some), block=block[some], part=rows.column("part").to_numpy()[some], **packed)])

    return found.where("part is not null").select("block", "part", "first", "lefts", "rights", "counts").groupBy("part").applyInArrow(task, _NAMED)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(candidates, totals). Candidates: lang, phrase, k, f, cover (the largest f of a phrase of one word more that has it, or null), ``heads`` and
    ``tails``: how often the first 1, 2, ... words and the rest after them occur. Totals: lang, n (words).

    A phrase is 2 to ``longest`` words of one piece that occur together ``least`` times or more. A null language is ``und``; null and empty texts have
    no words; texts are read whole, however long, repeated rows count each time. Other columns are ignored. An empty table gives empty ones.
    """
    spark = docs.sparkSession
    scratch, now = Scratch(spark), Scratch(spark)  # tables kept to the end, and those of a level, which go as soon as the next one's blocks are there
    found = now.keep(_blocks(docs, block_words))
    totals = written(found.where("codes is null").groupBy("lang").agg(F.sum("n").alias("n")))
    named = now.keep(_named(found, ["lang", "word"], least))
    words = totals.agg(F.sum("n")).head()[0] or 0
    bits = max(_RANGE, words.bit_length() + 1)
    first = F.col("block") * (1 << _NUMBERS) + F.col("code") == F.col("id")
    level = [scratch.keep(named.where(first).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.expr("cast(array() as array<bigint>)").alias("heads"), F.expr("cast(array() as array<bigint>)").alias("tails")))]
    for _ in range(2, longest + 1):
        step = Scratch(spark)
        own = named.select("block", "code", "id") if "code" in named.columns else named.where("block is not null").select("block", "codes", "ids")
        hashed = step.keep(_hashed(found.where("codes is not null").select("block", "codes"), own, least, bits))
        now.drop()
        now = Scratch(spark)
        found = now.keep(_pairs(hashed, _masks(hashed, least), bits))
        step.drop()
        named = now.keep(_named_pairs(found, least))
        pairs = named.where("block is null").select("id", "left", "right", "f")
        a = level[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("__a"), F.col("f").alias("__fa"), F.col("heads").alias("__ha"))
        b = level[-1].select(F.col("id").alias("right"), F.col("last").alias("__b"), F.col("f").alias("__fb"), F.col("tails").alias("__tb"))
        joined = pairs.join(a, "left").join(b, "right")
        level.append(scratch.keep(joined.select("id", "lang", F.concat_ws(" ", "__a", "__b").alias("phrase"), F.col("__b").alias("last"), "f", F.concat("__ha", F.array("__fa")).alias("heads"), F.concat(F.array("__fb"), "__tb").alias("tails"), "left", "right")))
    now.drop()
    out = None
    for k in range(1, longest):
        rows = level[k]
        if k + 1 < longest:
            above = level[k + 1]
            cover = above.select(F.col("left").alias("id"), "f").unionByName(above.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("cover"))
            rows = rows.join(cover, "id", "left")
        else:
            rows = rows.withColumn("cover", F.lit(None).cast("long"))
        rows = rows.select("lang", "phrase", F.lit(k + 1).alias("k"), "f", "cover", "heads", "tails")
        out = rows if out is None else out.unionByName(rows)
    out = written(out)
    scratch.drop()
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``most`` phrases.

    The score of a cut is floor(2,000,000 a / (l + r)); the lowest counts, of equal ones the first cut. A phrase within a longer one
    that occurs ``covered`` of 100 times as often, or more, is left out. Sums and products are decimals, so exact beyond 64 bits. Edge rows are as in ``phrases``.
    """
    found, totals = phrases(docs, least, longest, block_words)
    kept = found.where(f"cover is null or cast(100 as decimal(38,0)) * cover < cast({covered} as decimal(38,0)) * f")
    scores = "transform(sequence(1, k - 1), c -> named_struct('score', cast((cast(f as decimal(20,0)) * 2000000) div (cast(get(heads, c - 1) as decimal(20,0)) + get(tails, c - 1)) as bigint), 'cut', c))"
    kept = kept.withColumn("best", F.expr(f"array_min({scores})"))
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), F.expr("get(heads, best.cut - 1)").alias("l"), F.expr("get(tails, best.cut - 1)").alias("r"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language, then of the language, so that no task orders more than its parts' best
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("__part", part).withColumn("__nr", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__nr") <= most).drop("__nr", "__part")
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
with recursive pieces as (select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
cut as (select lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda w: w <> '') as ws from pieces),
grams as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from cut cross join (select unnest([1, 2, 3, 4]) as k) x) y),
f as materialized (select lang, k, phrase, count(*) as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as ws from f where k >= 2 and a >= 30),
cuts as (select c.*, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:], ' ') as tail from c cross join (select unnest([1, 2, 3]) as j) x where j < k),
scored as (select cuts.*, h.a as l, t.a as r, ((2000000::hugeint * cuts.a) // (h.a + t.a))::bigint as score from cuts join f h on h.lang = cuts.lang and h.k = j and h.phrase = head join f t on t.lang = cuts.lang and t.k = cuts.k - j and t.phrase = tail),
low as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as nr from scored) x where nr = 1),
inner_ as (select lang, a, array_to_string(ws[i:i + m - 1], ' ') as phrase from (select c.lang, c.a, c.ws, m, unnest(range(1, c.k - m + 2)) as i from c cross join (select unnest([2, 3]) as m) x where m < c.k) y),
cover as (select lang, phrase, max(a) as cover from inner_ group by 1, 2),
kept as (select low.* from low left join cover using (lang, phrase) where cover is null or 100::hugeint * cover < 80::hugeint * a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) x join n using (lang) where rank <= 2000"""


def op12_phrases(spark, sf_dir):
    """Each language's first 2,000 collocations of ``documents``."""
    from .common import documents

    return collocations(documents(spark, sf_dir))
