"""Backups that copy what changed."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsweave.sources import backups, sinks

DAY = datetime(2025, 1, 13, 12)


def lines(df):
    return sorted((row.run_date, row.value) for row in df.collect())


def test_second_backup_copies_nothing(spark, make_articles, tmp_path):
    source = str(tmp_path / "snapshots")
    kept = backups.SnapshotBackups(spark, str(tmp_path / "kept"))
    one, two = make_articles([{"url": "ü"}, {"url": "b"}, {"url": "b"}]), make_articles([{"url": "c"}])
    for n in range(3):
        sinks.save_json(one, source, date(2025, 1, 10 + n))
    states, wanted = [], [(3, 9, 3, 9), (3, 9, 0, 0), (4, 8, 2, 2), (4, 10, 0, 0)]
    for n, expected in enumerate(wanted):
        if n == 2:  # a run is repeated with other articles, and one is new
            sinks.save_json(two, source, date(2025, 1, 11))
            sinks.save_json(two, source, date(2025, 1, 13))
        if n == 3:  # an old state returns: its copy is still there
            sinks.save_json(one.repartition(3), source, date(2025, 1, 11))
        check = kept.take(source, DAY + timedelta(days=n)).first()
        assert tuple(check) == (*expected, True)
        states.append(lines(backups.read_snapshots(spark, source)))
    for n, state in enumerate(states):
        assert lines(kept.restore(DAY + timedelta(days=n))) == state
    assert kept.restore(DAY - timedelta(days=9)).count() == 0


def test_a_backup_that_did_not_end(spark, make_articles, tmp_path, monkeypatch):
    source, kept = str(tmp_path / "snapshots"), backups.SnapshotBackups(spark, str(tmp_path / "kept"))
    sinks.save_json(make_articles([{"url": "a"}, {"url": "b"}]), source, date(2025, 1, 10))
    whole = backups.contents
    with monkeypatch.context() as broken:
        calls = []

        def half(given):
            calls.append(1)
            return whole(given) if len(calls) == 1 else whole(given.limit(1))

        broken.setattr(backups, "contents", half)
        assert kept.take(source, DAY).first().identical is False
    assert kept.lists().count() == 0
    assert tuple(kept.take(source, DAY + timedelta(days=1)).first()) == (1, 2, 1, 2, True)


def test_dates_and_times_outside_the_session_zone(spark, tmp_path):
    source, kept = str(tmp_path / "snapshots"), backups.SnapshotBackups(spark, str(tmp_path / "kept"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        kept.take(source, DAY)
    spark.range(3).select(F.col("id").cast("string").alias("value"), F.lit("2025-01-10").alias("run_date")).write.partitionBy(
        "run_date").text(source)
    kept.take(source, datetime(2025, 3, 9, 2, 30))
    assert kept.restore(datetime(2025, 3, 9, 2, 30)).count() == 3
