"""The store on disk, snapshots, the daily run, and streams into the store."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsweave.plans.daily_run import daily_run, store_statistics
from newsweave.sources import sinks
from newsweave.sources.store import ArticleStore
from newsweave.streaming import articles as streaming

ARRIVAL = ["source_rank", "payload_id", "position"]
DAY = datetime(2025, 1, 13, 12)


@pytest.fixture
def store(spark, tmp_path):
    return ArticleStore(spark, str(tmp_path / "store"))


def named(*urls, **fields):
    return [{"url": url, "title": f"{url} title", **fields} for url in urls]


def held(store):
    return {row.url: (row.article_id[-8:], row.scraped_at) for row in store.current().collect()}


def test_empty_store_reads_as_empty(store):
    assert store.current().count() == 0
    assert store.recent(DAY).count() == 0


def test_save_keeps_ids_and_counts(store, make_articles):
    first = store.save(make_articles(named("a", "b", "a", "")), "1", ARRIVAL, DAY - timedelta(days=2)).first()
    assert (first.inserted, first.updated, first.rejected) == (2, 1, 1)
    second = store.save(make_articles(named("b", "c")), "2", ARRIVAL, DAY).first()
    assert (second.inserted, second.updated) == (1, 1)
    assert held(store) == {"a": ("20250111", DAY - timedelta(days=2)), "b": ("20250111", DAY), "c": ("20250113", DAY)}


def test_saving_a_batch_again_changes_nothing(store, make_articles):
    store.save(make_articles(named("a")), "1", ARRIVAL, DAY - timedelta(days=1))
    outcomes = [store.save(make_articles(named("a", "b")), "2", ARRIVAL, DAY).first() for _ in range(2)]
    assert outcomes[0] == outcomes[1]
    assert store.log().count() == 3 and len(held(store)) == 2


def test_batch_names_are_folder_names(store, make_articles):
    with pytest.raises(ValueError):
        store.save(make_articles(named("a")), "12:30/x", ARRIVAL, DAY)


def test_purge_drops_days_and_trims_the_boundary(store, make_articles):
    for n, hours in enumerate([0, 20, 30, 47, 49, 60, 90]):
        store.save(make_articles(named(f"u{n}")), str(n), ARRIVAL, DAY - timedelta(hours=hours))
    store.save(make_articles(named("u6")), "again", ARRIVAL, DAY)
    cutoff = DAY - timedelta(hours=48)
    dry = store.purge(DAY, cutoff=cutoff, dry_run=True).first()
    assert (dry.would_delete_count, dry.total_remaining) == (2, 7)
    done = store.purge(DAY, cutoff=cutoff).first()
    assert (done.deleted_count, done.total_remaining) == (2, 5)
    assert set(held(store)) == {"u0", "u1", "u2", "u3", "u6"}
    assert held(store)["u6"][0] == "20250109"
    days = {folder.name for folder in Path(store.path).glob("scraped_date=*/batch=*/*.parquet")}
    assert days and min(store.log().select("scraped_at").toPandas().scraped_at) >= cutoff
    assert store.purge(DAY, cutoff=cutoff).first().deleted_count == 0


def test_recent_reads_only_its_days(store, make_articles):
    for n in range(12):
        store.save(make_articles(named(f"u{n}")), f"{n:02}", ARRIVAL, DAY - timedelta(days=n))
    store.save(make_articles(named("u11")), "99", ARRIVAL, DAY + timedelta(minutes=1))
    assert [row.url for row in store.recent(DAY, 7, 3).collect()] == ["u11", "u0", "u1"]
    plan = store.recent(DAY)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scraped_date" in plan


def test_the_last_save_wins(store, make_articles):
    """With equal and with older times, whatever the batch names."""
    store.save(make_articles(named("a", "b", title="first")), "9", ARRIVAL, DAY)
    store.save(make_articles(named("a", title="second")), "10", ARRIVAL, DAY)
    store.save(make_articles(named("b", title="older")), "1", ARRIVAL, DAY - timedelta(days=20))

    def titles():
        return {row.url: row.title for row in store.current().collect()}

    assert titles() == {"a": "second", "b": "older"}
    store.save(make_articles(named("a", "b", title="first")), "9", ARRIVAL, DAY)
    assert titles() == {"a": "second", "b": "older"}
    assert [row.url for row in store.recent(DAY).collect()] == ["a"]
    report = store.purge(DAY, cutoff=DAY - timedelta(days=10)).first()
    assert (report.deleted_count, report.total_remaining) == (1, 1)
    assert titles() == {"a": "second"} and store.log().where("url = 'b'").count() == 0


def test_failing_purge_and_empty_run(spark, store, make_articles, tmp_path, monkeypatch):
    pages = spark.createDataFrame([], "url string, html string")
    monkeypatch.setattr(type(store), "purge", lambda *_: 1 / 0)
    shown = daily_run(make_articles(named("a")), pages, store, str(tmp_path / "snap"), DAY)
    assert shown["purge"].first().success is False and shown["outcome"].first().inserted == 1
    other = str(tmp_path / "none")
    shown = daily_run(make_articles(named("")), pages, store, other, DAY + timedelta(days=1))
    assert not Path(other).exists() and shown["total"].first().total_articles == 1
    assert shown["outcome"].first().success is False and shown["urls"].count() == 0


def test_compaction_keeps_the_current_rows(store, make_articles, tmp_path):
    store.save(make_articles(named("a", "b")), "1", ARRIVAL, DAY - timedelta(days=1))
    store.save(make_articles(named("b")), "2", ARRIVAL, DAY)
    packed = store.compact(str(tmp_path / "packed"))
    assert held(packed) == held(store) and packed.log().count() == 2


def test_times_outside_the_session_calendar(store, make_articles):
    """02:30 on that day does not exist in the session's time zone."""
    gap = datetime(2024, 3, 10, 2, 30)
    store.save(make_articles(named("a")), "1", ARRIVAL, gap)
    row = store.current().first()
    assert (row.scraped_at, row.published, row.article_id[-8:]) == (gap, "2024-03-10T02:30:00", "20240310")
    assert store.recent(gap, 1).count() == 1


def test_statistics(store, make_articles):
    store.save(make_articles(named("a", "b", source="x") + named("c", source="y")), "1", ARRIVAL, DAY)
    shown = store_statistics(store, DAY)
    assert shown["ages"].first().total_articles == 3
    assert [tuple(row) for row in shown["sources"].collect()] == [("x", 2), ("y", 1)]


def test_json_snapshot_and_backup(spark, make_articles, tmp_path):
    given = make_articles(named("ü", "b")).withColumn("scraped_at", F.lit("2025-01-13 12:00:00").cast("timestamp_ntz"))
    target = sinks.save_json(given, str(tmp_path / "snap"), date(2025, 1, 13))
    sinks.save_json(given.limit(1), str(tmp_path / "snap"), date(2025, 1, 12))
    back = spark.read.json(target)
    assert {(r.url, r.scraped_at) for r in back.collect()} == {("ü", "2025-01-13T12:00:00"), ("b", "2025-01-13T12:00:00")}
    raw = "".join(p.read_text(encoding="utf8") for p in Path(target).glob("part-*"))
    assert '"url":"ü"' in raw
    (check,) = sinks.backup(spark, str(tmp_path / "snap"), str(tmp_path / "kept"), DAY).collect()
    assert (check.source_rows, check.copied_rows, check.identical) == (3, 3, True)


def test_daily_run_twice_is_the_same(spark, store, make_articles, tmp_path):
    store.save(make_articles(named("old")), "0", ARRIVAL, DAY - timedelta(days=90))
    given = make_articles(named("a", "b", "a") + named("c", published="2025-01-12", summary="text"))
    pages = spark.createDataFrame([], "url string, html string")
    for _ in range(2):
        shown = daily_run(given, pages, store, str(tmp_path / "snap"), DAY, size=2)
        assert (shown["outcome"].first().inserted, shown["total"].first().total_articles) == (2, 2)
        assert [row.url for row in shown["urls"].orderBy("number").collect()] == ["c", "a"]
        assert shown["preview"].where("number = 1").first().summary_preview == "text"
    assert set(held(store)) == {"c", "a"}
    assert spark.read.json(str(tmp_path / "snap")).count() == 2


@pytest.fixture
def landing(spark, make_articles, tmp_path):
    """Articles landed in three files, one address in each of them."""
    folder = str(tmp_path / "landed")
    schema = None
    for n in range(3):
        part = make_articles(named("same", f"only{n}", "")).withColumn(
            "scraped_at", F.lit((DAY + timedelta(days=n)).isoformat()).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(folder)
        schema = part.schema
    return folder, schema


def test_stream_unique(spark, landing, tmp_path):
    stream = streaming.landed(spark, *landing, files_per_trigger=1)
    out = str(tmp_path / "out")
    for _ in range(2):
        streaming.write_available(
            streaming.stream_unique(stream, "30 days", ARRIVAL).select("url"), out, str(tmp_path / "progress"))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["only0", "only1", "only2", "same"]


def test_stream_upsert_and_replay(spark, landing, store, tmp_path):
    stream = streaming.landed(spark, *landing, files_per_trigger=1)
    for checkpoint in ("one", "two"):
        streaming.upsert_available(stream, store, ARRIVAL, str(tmp_path / checkpoint))
        assert set(held(store)) == {"same", "only0", "only1", "only2"}
        assert held(store)["same"][1] == DAY + timedelta(days=2)
    assert held(store)["same"][0] == "20250113"
