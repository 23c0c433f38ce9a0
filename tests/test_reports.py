"""Queries of errors and reports against their SQL, on recordings with much noise and misplaced heels; both triangulate every moment of the common clock."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.jobs import queries


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    """Recordings 10 and 11."""
    folder = tmp_path_factory.mktemp("noisy")
    spark.range(10_000, 12_000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["reprojection_stats", "recording_report"])
def test_all_moments_are_triangulated_and_equal_the_sql(spark, noisy, monkeypatch, name):
    real, taken = queries.reconstruction.triangulated, []

    def triangulated(synced, *args, **kwargs):
        taken.append(synced.select("recording", "tau").distinct().count())
        return real(synced, *args, **kwargs)

    monkeypatch.setattr(queries.reconstruction, "triangulated", triangulated)
    cur = duckdb.connect().execute(queries.SQL[name].replace("from events", f"from '{noisy}/events.parquet/*.parquet'"))
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = queries.QUERIES[name](spark, noisy).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) in (2, 6)
    assert taken == [queries.times_of(queries.X.keypoints(spark, noisy, False, False)).count()] and taken[0] > 1900
