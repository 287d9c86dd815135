"""The index beside the store's rows: pruned lookups, counted changes, work that did not end."""

import random
from datetime import datetime, timedelta

import pytest

from newsweave.operators.ranking import keep_first
from newsweave.operators.statistics import age_buckets, top_sources
from newsweave.plans.daily_run import store_statistics
from newsweave.sources import store as store_module
from newsweave.sources.store import ArticleStore

ARRIVAL = ["source_rank", "payload_id", "position"]
DAY = datetime(2025, 1, 13, 12)


def named(*urls, **fields):
    return [{"url": url, **fields} for url in urls]


def scanned(store):
    """Counts by time and source from all rows."""
    rows = store.current().groupBy("scraped_at", "source").count().collect()
    return sorted(map(tuple, rows), key=repr)


def counted(store):
    return sorted(map(tuple, store.counts().collect()), key=repr)


def test_lookup_reads_the_partitions_of_its_addresses(spark, make_articles, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "store"), buckets=64)
    store.save(make_articles(named(*[f"u{n}" for n in range(600)])), "1", ARRIVAL, DAY)
    total = len(store.entries().inputFiles())
    assert total == 64
    few = make_articles(named("u5", "u77", "new"))
    near = store.index.near(few)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [url_bucket" in plan
    buckets = near.select("url_bucket").distinct().count()
    assert 1 <= buckets <= 2 and "BroadcastHashJoin" in plan
    assert {row.url for row in near.collect()} == {"u5", "u77"}
    outcome = store.save(few, "2", ARRIVAL, DAY + timedelta(days=1)).first()
    assert (outcome.inserted, outcome.updated) == (1, 2)


def test_changes_equal_the_full_scan(spark, make_articles, tmp_path):
    rng = random.Random(3)
    store = ArticleStore(spark, str(tmp_path / "store"))
    batches = {}
    for n in range(4):
        urls = rng.sample(range(12), 6)
        batches[f"b{n}"] = (named(*[f"u{u}" for u in urls], source=f"s{n % 2}"), DAY - timedelta(days=30 - 9 * n))
    for name in ("b0", "b1", "b2", "b1", "b3", "b0"):  # two are saved again
        rows, at = batches[name]
        store.save(make_articles(rows), name, ARRIVAL, at)
    assert counted(store) == scanned(store)
    store.purge(DAY, cutoff=DAY - timedelta(days=20))
    assert counted(store) == scanned(store)
    rows, at = batches["b2"]
    store.save(make_articles(rows), "b2", ARRIVAL, at)
    store.save(make_articles(named("u1", "z", source=None)), "b9", ARRIVAL, DAY)
    assert counted(store) == scanned(store)
    shown, current = store_statistics(store, DAY), store.current()
    assert shown["ages"].first() == age_buckets(current, DAY).first()
    assert shown["sources"].collect() == top_sources(current).collect()
    index = store.entries().select("url", "article_id", "saved").collect()
    assert sorted(index) == sorted(store.log().select("url", "article_id", "saved").collect())


def test_a_store_of_rows_alone(spark, make_articles, tmp_path):
    """Rows without an index get one; numbers go on behind the last save."""
    first = ArticleStore(spark, str(tmp_path / "store"))
    first.save(make_articles(named("a")), "9", ARRIVAL, DAY)
    first.save(make_articles(named("a", "b")), "10", ARRIVAL, DAY)
    copy = first.compact(str(tmp_path / "copy"))
    assert counted(copy) == counted(first)
    outcome = copy.save(make_articles(named("b", "c")), "1", ARRIVAL, DAY + timedelta(days=1)).first()
    assert (outcome.inserted, outcome.updated) == (1, 1)
    assert {row.saved for row in copy.current().where("url != 'a'").collect()} == {3}


@pytest.mark.parametrize("step", ["add", "add_changes", "end"])
def test_a_save_that_did_not_end(spark, make_articles, tmp_path, monkeypatch, step):
    store = ArticleStore(spark, str(tmp_path / "store"))
    store.save(make_articles(named("a")), "1", ARRIVAL, DAY)
    with monkeypatch.context() as broken:
        broken.setattr(type(store.index), step, lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.save(make_articles(named("a", "b")), "2", ARRIVAL, DAY + timedelta(days=1))
    outcome = store.save(make_articles(named("b", "c")), "3", ARRIVAL, DAY + timedelta(days=2)).first()
    assert (outcome.inserted, outcome.updated) == (1, 1)
    assert counted(store) == scanned(store) and store.index.unfinished() == []
    assert {row.url: row.article_id[-8:] for row in store.current().collect()} == {"a": "20250113", "b": "20250114", "c": "20250115"}


@pytest.mark.parametrize("removals", range(3))
def test_a_purge_that_did_not_end(spark, make_articles, tmp_path, monkeypatch, removals):
    """Stopped at any removal, every article that stays is there, and a second purge ends it."""
    store = ArticleStore(spark, str(tmp_path / "store"))
    cutoff = DAY - timedelta(days=10)
    store.save(make_articles(named("old", "kept")), "1", ARRIVAL, DAY - timedelta(days=40))
    store.save(make_articles(named("gone")), "2", ARRIVAL, DAY - timedelta(days=1))
    store.save(make_articles(named("gone", "older")), "3", ARRIVAL, DAY - timedelta(days=30))
    store.save(make_articles(named("kept", "x")), "4", ARRIVAL, DAY)
    store.save(make_articles(named("edge")), "5", ARRIVAL, cutoff)
    left, remove = [removals], store_module.remove_folder

    def failing(spark, folder):
        if "/scraped_date=" in folder:
            left[0] -= 1
            if left[0] < 0:
                raise OSError(folder)
        remove(spark, folder)

    with monkeypatch.context() as broken:
        broken.setattr(store_module, "remove_folder", failing)
        with pytest.raises(OSError):
            store.purge(DAY, cutoff=cutoff)
    assert {"kept", "x", "edge"} <= {row.url for row in store.current().collect()}
    report = store.purge(DAY, cutoff=cutoff).first()
    assert report.total_remaining == 3
    assert {row.url for row in store.current().collect()} == {"kept", "x", "edge"}
    assert counted(store) == scanned(store)


def test_statistics_do_not_read_the_rows(spark, make_articles, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "store"))
    store.save(make_articles(named("a", "b", source="x")), "1", ARRIVAL, DAY)
    assert all("/_state/changes." in path for path in store.counts().inputFiles())
    known = keep_first(store.entries(), ["saved"])
    assert all("/_state/addresses." in path for path in known.inputFiles())
