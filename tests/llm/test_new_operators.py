"""Hard negatives, collocations and archives against brute-force twins, with edge rows, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import archives, negatives, phrases

VECTORS = "vec_id long, embedding array<float>, label int, score int, part int"


def slow_negatives(rows, every):
    own = []
    for vec_id, e, label, *_ in rows:
        if vec_id is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            own.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in e], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, x, la) in enumerate(own):
        if a % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), b, lb) for j, (b, y, lb) in enumerate(own) if j != i)
            for s, b, _ in [r for r in scored if r[2] == la][:5]:
                fits = [r for r in scored if r[2] != la and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
                out += [(a, b, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.4], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8, i % 3) for i in range(150)]  # ties
    rows += [(1000, [0.5] * 8, 0), (1000, [0.5] * 8, 0), (50, [0.1] * 8, 2)]  # repeated rows, a repeated id
    rows += [(None, [1.0] * 8, 1), (1500, None, 1), (1550, [1.0] * 8, None), (1600, [1.0, None], 1), (1650, [float("nan")] * 8, 1), (1700, [float("inf")], 1), (1750, [], 1), (1800, [2.0, 1.0], 1), (1850, [0.25] * 11, 2), (1900, [-100.0] * 8, 3)]
    return [(*r, 1, 2) for r in rows]


@pytest.mark.parametrize("part_rows,block_rows,leaf", [(1 << 15, 1 << 13, 256), (97, 7, 8)])
def test_hard_negatives_equal_brute_force(spark, part_rows, block_rows, leaf):
    rows = vector_rows()
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), part_rows=part_rows, block_rows=block_rows, leaf=leaf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows, 50)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, 0, 0)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(50, [1e8] * 4, 1, 0, 0), (51, [1e8] * 4, 1, 0, 0)], VECTORS)).count()


def test_tree_passes_over_nodes_and_loses_nothing():
    rng = np.random.default_rng(1)
    values = rng.integers(-300, 300, (3000, 3))
    tree = negatives.Tree.build(np.arange(3000), np.arange(3000), rng.integers(0, 3, 3000), values, leaf=32)
    assert all(np.sqrt(((tree.values[a:b] - c) ** 2).sum(axis=1)).max() <= r + 1e-6 for (a, b), c, r in zip(tree.span, tree.centre, tree.radius))
    q = rng.integers(-300, 300, (20, 3))
    low, high = np.full((20, 1), 1000), np.full((20, 1), 20000)
    best, place = tree.search(np.full(20, -1), np.zeros(20, np.int64), q, 4, low, high, False)
    for i in range(20):
        scores = tree.values @ q[i]
        ok = (tree.label != 0) & (scores >= 1000) & (scores <= 20000)
        want = sorted(zip(-scores[ok], tree.vec_id[ok]))[:4]
        assert [(-best[i, 0, m], tree.vec_id[place[i, 0, m]]) for m in range(len(want))] == [(s, v) for s, v in want]


def slow_phrases(rows, least, covered, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text, lang = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""), "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(o) > len(p) and 100 * b >= covered * a and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1)) for o, b in found.items()):
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


DOCS = "doc_id long, text string, lang string, n int, score int, left int"


def phrase_rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "É", " x", "gamma\x00", "d", "d", "zeta"]
    texts = [" ".join(words[i] + ("." if j % 9 == 8 else "") for j, i in enumerate(rng.integers(0, len(words), rng.integers(0, 60)))) for _ in range(120)]
    texts += [None, "", " \t ", "d " * 300, "one\ttwo  three,one two\nthree;" * 40, "one two three four five " * 35, "x" * 5000 + " " + "y" * 100] + ["same old line"] * 40
    return [(i if i % 5 else None, t, [None, "de", "und", "fr"][i % 4], 1, 1, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_words", [1 << 21, 50])
def test_collocations_equal_brute_force(spark, block_words):
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least=5, most=60, block_words=block_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, 5, 80, 60)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, 1, 1), (2, "one", "de", 1, 1, 1)], DOCS)).count() == 0


PAGES = "page_id long, url string, html string, shard int, first int, member int"


def page_rows():
    rng = np.random.default_rng(2)
    pages = [(i, f"http://a.example/{i}", "".join(chr(int(c)) for c in rng.integers(32, 900, rng.integers(0, 400)))) for i in range(120)]
    pages += [(200 + i, "http://b.example/x y\r\nEvil: 1", "<p>copied</p>\r\n\r\n") for i in range(90)]
    pages += [(7, None, "<p>copied</p>\r\n\r\n"), (289, "u", "<p>copied</p>\r\n\r\n"), (289, "u", "<p>copied</p>\r\n\r\n"), (None, None, None), (None, "n", None), (300, "", ""), (301, "é", "long é" * 50000), (None, "m", "alone"), (5, "again", "other")]
    return [(*p, 1, 1, 1) for p in pages]


def slow_archive(rows, least):
    own = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    first, seen, out = {}, Counter(), []
    for i, b in own:
        if b not in first or first[b] is None or i is not None and i > first[b]:
            first[b] = i
    for i, b in own:
        seen[(i, b)] += 1
        turn = len(b) < least or i == first[b] and seen[(i, b)] == 1
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if turn else "revisit", None if turn else first[b]))
    return sorted(out, key=repr)


def stored(spark, rows, folder, **how):
    table = spark.createDataFrame(rows, PAGES).repartition(5)
    files = archives.write_archives(table, f"file://{folder}", **how)
    found = archives.read_archives(spark, f"file://{folder}", payloads=True).collect()
    number = lambda x: None if x is None else int(x)
    return files.orderBy("name").collect(), sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found), key=repr), found


@pytest.mark.parametrize("least", [0, 10, 1000])
def test_archives_round_trip(spark, tmp_path, least):
    rows = page_rows()
    files, got, found = stored(spark, rows, tmp_path / "a", least_payload=least, shard_bytes=20000, roll_bytes=6000)
    assert got == slow_archive(rows, least)
    assert sum(f.records for f in files) == len(rows) and len({f.shard for f in files}) > 2 and any(f.turn for f in files)
    payloads = {(None if r.page_id is None else int(r.page_id), bytes(r.payload)) for r in found if r.record_type == "response"}
    assert payloads <= {(i, (h or "").encode()) for i, _, h, *_ in rows}
    assert archives.damaged(spark, f"file://{tmp_path}/a").count() == 0
    assert all("\r" not in r.url and " " not in r.url for r in found)
    again, _, _ = stored(spark, rows[::-1], tmp_path / "b", least_payload=least, shard_bytes=20000, roll_bytes=6000)
    assert [tuple(f) for f in again] == [tuple(f) for f in files]  # the same files, byte for byte, in whatever order the rows came


def test_archive_records_are_members_that_other_readers_take(spark, tmp_path):
    import gzip

    stored(spark, page_rows(), tmp_path / "a")
    names = sorted(p for p in (tmp_path / "a").iterdir() if p.name.endswith(".warc.gz"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in names)
    kinds = Counter(re.findall(rb"WARC/1\.1\r\nWARC-Type: (\w+)\r\n", text))
    assert sum(kinds.values()) == len(page_rows()) + len(names) and kinds[b"warcinfo"] == len(names)
    for head, block in (archives.parsed(m) for p in names for m in archives.members(p.read_bytes())):
        assert head["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_archives_of_nothing_and_unfinished_ones(spark, tmp_path):
    files, got, _ = stored(spark, [], tmp_path / "a")
    assert files == [] and got == []
    with pytest.raises(ValueError, match="holds an archive"):
        archives.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/a")
    with pytest.raises(ValueError, match="no manifest"):
        archives.read_archives(spark, f"file://{tmp_path}/b")
    texts = spark.createDataFrame([("ü/1", None, "x"), (None, None, "x"), ("a:b", "u", "x")], "page_id string, url string, html string")
    archives.write_archives(texts, f"file://{tmp_path}/c")
    got = archives.read_archives(spark, f"file://{tmp_path}/c").select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("ü/1", "response", None), (None, "revisit", "ü/1"), ("a:b", "revisit", "ü/1")], key=repr)


def test_damage_is_found(spark, tmp_path):
    stored(spark, page_rows(), tmp_path / "a")
    one = next(p for p in (tmp_path / "a").iterdir() if p.name.endswith(".warc.gz"))
    one.write_bytes(one.read_bytes()[:-20])
    (one.parent / f".{one.name}.crc").unlink(missing_ok=True)
    assert [r.name for r in archives.damaged(spark, f"file://{tmp_path}/a").collect()] == [one.name]
    with pytest.raises(Exception, match="ends within a record"):
        archives.read_archives(spark, f"file://{tmp_path}/a").count()


@pytest.mark.parametrize("name", ["op11_negatives", "op12_phrases", "op13_warc"])
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    from trackloom.llm import registry

    con = duckdb.connect()
    for t in ("embeddings", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = registry.queries()[name](spark, small)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))
