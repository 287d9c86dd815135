"""First arrivals and daily counts of streams against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsweave.operators.ranking import keep_first
from newsweave.operators.statistics import daily_arrivals
from newsweave.streaming import articles as streaming
from newsweave.streaming.firsts import DailyCounts, firsts_available

ARRIVAL = ["source_rank", "payload_id", "position"]
DAY = datetime(2025, 1, 13, 12)


@pytest.fixture
def land(make_articles, tmp_path):
    """Rows (url, hours) landed in files, each file a micro-batch in the order given."""
    folder = str(tmp_path / "landed")

    def run(files, first_position=0):
        at = first_position
        for rows in files:
            part = make_articles([{"url": url, "source": f"s{hours % 3}"} for url, hours in rows])
            times = F.array(*[F.lit((DAY + timedelta(hours=h)).isoformat()) for _, h in rows])
            part = part.withColumn("scraped_at", F.get(times, F.col("position")).cast("timestamp_ntz"))
            part = part.withColumn("position", (F.lit(1000) - F.col("position") - at).cast("int"))
            part.coalesce(1).write.mode("append").parquet(folder)
            at += len(rows)
        return folder, part.schema

    return run


def test_first_arrival_whatever_lands_first(spark, land, tmp_path):
    """Later files hold the earlier arrivals, in other windows too."""
    rng = random.Random(6)
    files = [[(f"u{rng.randrange(9)}" if rng.random() < 0.9 else "", rng.randrange(200)) for _ in range(12)] for _ in range(4)]
    folder, schema = land(files)
    stream = streaming.landed(spark, folder, schema, files_per_trigger=1)
    out = str(tmp_path / "firsts")
    for progress in ("one", "one", "two"):  # run again, and replayed from the start
        firsts_available(stream, out, str(tmp_path / progress), "30 days", ARRIVAL)
        found = spark.read.parquet(out).select("url", "position", "source", "scraped_at").collect()
        wanted = keep_first(spark.read.parquet(folder), ARRIVAL).select("url", "position", "source", "scraped_at").collect()
        assert sorted(found) == sorted(wanted)
    land([[("u1", 0), ("new", 3)]], 500)
    firsts_available(stream, out, str(tmp_path / "one"), "30 days", ARRIVAL)
    found = {row.url: row.position for row in spark.read.parquet(out).collect()}
    assert found == {row.url: row.position for row in keep_first(spark.read.parquet(folder), ARRIVAL).collect()}
    assert found["new"] == 499 and found["u1"] == 500


def test_late_rows_are_set_aside(spark, land, tmp_path):
    folder, schema = land([[("a", 0), ("b", 100)], [("c", 49), ("d", 51), ("e", 200)], [("f", 149), ("g", 151), ("", 0)]])
    # One file after another, as they were named by their times.
    stream = streaming.landed(spark, folder, schema, files_per_trigger=1)
    whole = spark.read.parquet(folder)
    for progress in ("one", "two"):
        counts = DailyCounts(spark, str(tmp_path / "counts"), timedelta(hours=50))
        counts.update(stream, str(tmp_path / progress))
        late = counts.late(whole)
        assert {row.url for row in late.collect()} == {"c", "f", ""}
        counted = counts.counts()
        assert counted.agg(F.sum("articles")).first()[0] + late.count() == whole.count()
        wanted = daily_arrivals(whole.where("url not in ('c', 'f', '')")).collect()
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, wanted))


def test_no_rows(spark, make_articles, tmp_path):
    given = make_articles([]).withColumn("scraped_at", F.lit(None).cast("timestamp_ntz"))
    counts = DailyCounts(spark, str(tmp_path / "none"), timedelta(days=1))
    assert counts.counts().count() == 0 and counts.late(given).count() == 0
