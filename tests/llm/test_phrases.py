"""Rare pairs of frequent words are counted by hash and are not exchanged."""

import numpy as np
import pytest

from trackloom.llm import phrases


@pytest.mark.parametrize("counter_range", [22, 6])
def test_rare_pairs_are_not_exchanged_and_frequent_ones_lose_none(spark, monkeypatch, counter_range):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 80, 400)) for _ in range(50)] + ["w1 w2 w3"] * 30 + ["w9 w8"] * 29
    words = [t.split() for t in texts]
    pairs = {}
    for w in words:
        for p in zip(w, w[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    rows = []
    real = phrases._named_pairs

    def named_pairs(found, least):
        rows.append(sum(len(phrases._unpacked(r.counts, np.int64)) for r in found.where("part is not null").select("counts").collect()))
        return real(found, least)

    monkeypatch.setattr(phrases, "_named_pairs", named_pairs)
    monkeypatch.setattr(phrases, "_RANGE", counter_range, raising=False)
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    found, totals = phrases.phrases(docs, least=30, block_words=2000)
    got = {tuple(r.phrase.split()): r.f for r in found.where("k = 2").collect()}
    assert got == {p: n for p, n in pairs.items() if n >= 30} and ("w1", "w2") in got
    assert [tuple(r) for r in totals.collect()] == [("en", sum(map(len, words)))]
    assert rows[0] < 1000 < len(pairs)  # 10 blocks of about 2,000 words, nearly each pair of which is another one
