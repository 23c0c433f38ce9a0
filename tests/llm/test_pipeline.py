from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_stages_on_small_data(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    before = docs.count()
    rows = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(rows) < before and rows[0].taken > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == names


def test_all_numbered_queries_are_registered():
    numbers = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


def edge_rows(spark, small):
    """Real documents, two of them twice, one with a near copy, and rows with nulls, an empty text and a long one; two columns clash."""
    real = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(12).collect()
    rows = [tuple(r) for r in [*real, real[0], real[1]]]
    words = "".join(f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}word" for i in range(600))
    rows += [(9000, words, "en", "a", len(words)), (9001, words.replace(" aaword", " changed", 1), "en", "a", len(words))]
    rows += [(None, "a text without an id", "en", None, None), (9002, None, None, None, None), (9003, "", "en", "a", 0), (9004, words * 40, None, "a", 40 * len(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in ("node", "score", "size", "taken_from", "line")})


def test_every_stage_on_edge_rows_and_on_no_rows(spark, small):
    docs = edge_rows(spark, small)
    own = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    ids = Counter(i for i, _ in own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert set(docs.columns) <= set(out.columns), name
        got = out.select("doc_id", "text").collect()
        left = Counter(r.doc_id for r in got)
        assert all(left[i] <= ids[i] for i in left), name
        if name == "lines":  # no row goes and a null stays null
            assert left == ids and [r.text for r in got if r.doc_id == 9002] == [None]
        elif name == "near_duplicates":
            assert max(left.values()) == 1 and left[9000] == 1 and left[9001] == 0 and left[9002] + left[9003] == 1
        else:
            assert {(r.doc_id, r.text) for r in got} <= set(own), name
        assert stage(spark, docs.limit(0), small).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, small).collect()} >= {9000, 9002, 9003, None}
    mix = corpus_pipeline.mixed(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), small).collect()
    assert all(0 < r.taken <= 2 * r.size for r in mix) and not {9002, 9003} & {r.doc_id for r in mix}
    assert corpus_pipeline.mixed(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0), small).count() == 0
