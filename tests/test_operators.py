"""Dedupe, caps, order, images, upsert, retention, statistics and the digest."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsweave.operators import images, ranking, retention, statistics, upsert
from newsweave.plans.digest import digest, digest_order
from newsweave.plans.reports import article_preview, url_list

RUN_TS = datetime(2025, 1, 13, 15, 30)
ARRIVAL = ["source_rank", "payload_id", "position"]
SAMPLE = [
    {"title": "One", "url": "https://north.test/tides?id=1", "published": "2025-01-01T10:00:00Z"},
    {"title": "Two", "url": "https://south.test/winds", "published": "2025-01-02T10:00:00Z"},
]


def test_dedupe_keeps_first_of_each_url(make_articles):
    given = make_articles(SAMPLE + [SAMPLE[0] | {"title": "Again"}, {"url": ""}, {"url": None},
                                    {"url": "HTTPS://north.test/tides?id=1", "title": "Other case"}])
    kept = ranking.keep_first(given, ARRIVAL).orderBy(*ARRIVAL).collect()
    assert [row.title for row in kept] == ["One", "Two", "Other case"]
    (counts,) = statistics.dedup_metrics(given).collect()
    assert (counts.rows_in, counts.blank_urls, counts.rows_out, counts.removed) == (6, 2, 3, 3)


def test_keep_last(make_articles):
    kept = ranking.keep_last(make_articles(SAMPLE + [SAMPLE[0] | {"title": "Again"}]), ARRIVAL)
    assert {row.title for row in kept.collect()} == {"Again", "Two"}


def test_dedupe_with_one_address_on_a_third_of_all_rows(spark):
    rows = spark.range(0, 90_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"), "id")
    kept = ranking.keep_first(rows, ["id"])
    assert kept.count() == 60_001
    assert kept.where("url = 'hot'").select("id").collect()[0].id == 0


def test_caps(make_articles):
    given = make_articles([{"source": "a"}] * 5 + [{"source": "b"}] * 2 + [{"source": "c"}] * 4)
    fixed = ranking.cap_per_source(given, ["source"], ARRIVAL, 3)
    assert {r.source: r["count"] for r in fixed.groupBy("source").count().collect()} == {"a": 3, "b": 2, "c": 3}
    by_row = ranking.cap_per_source(given, ["source"], ARRIVAL, F.when(F.col("source") == "a", 4).otherwise(1), 4)
    assert sorted(r.position for r in by_row.collect()) == [0, 1, 2, 3, 5, 7]
    cap = F.when(F.col("source") == "a", 4).when(F.col("source") == "b", 1)
    unbounded = ranking.cap_per_source(given, ["source"], ARRIVAL, cap)
    assert sorted(r.position for r in unbounded.collect()) == [0, 1, 2, 3, 5]
    with pytest.raises(Exception, match="exceeds its bound of 3"):
        ranking.cap_per_source(given, ["source"], ARRIVAL, F.lit(5), 3).collect()


def test_newest_first_is_stable_and_puts_undated_last(make_articles):
    given = make_articles([{"published": p} for p in
                           ["nonsense", "2025-01-01", "2025-01-02T00:00:00+05:00", "", "2025-01-01T00:00:00Z",
                            "Mon, 13 Jan 2025 12:00:00 GMT"]])
    ordered = ranking.newest_first(ranking.with_published_time(given), ARRIVAL)
    assert [row.position for row in ordered.collect()] == [2, 1, 4, 0, 3, 5]
    with_mail_dates = ranking.with_published_time(given, parse_rfc822=True)
    assert ranking.newest_first(with_mail_dates, ARRIVAL).first().position == 5


def test_number_rows_counts_through_partitions(spark):
    rows = spark.range(0, 20_000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("day"), "id")
    numbered = ranking.number_rows(rows, [F.desc_nulls_last("day"), F.col("id")], "place").collect()
    expected = sorted(range(20_000), key=lambda n: (-1 if n % 3 else 0, -(n % 50) if n % 3 else 0, n))
    assert [row.id for row in sorted(numbered, key=lambda row: row.place)] == expected
    assert [row.place for row in sorted(numbered, key=lambda row: row.place)] == list(range(1, 20_001))


@pytest.fixture
def pages(spark):
    meta = '<meta property="og:image" content="https://cdn.example.com/{}.jpg">'
    return spark.createDataFrame(
        [("https://bbc.com/1", 1, meta.format("old")), ("https://bbc.com/1", 2, meta.format("new")),
         ("https://bbc.com/2", 1, "<p>none</p>"), ("https://else.example/3", 1, meta.format("untrusted"))],
        "url string, captured int, html string")


MIXED = [
    {"url": "https://bbc.com/1", "image": " ", "published": "2025-01-04"},
    {"url": "https://bbc.com/2", "image": None, "published": "2025-01-03"},
    {"url": "https://else.example/3", "image": "", "published": "2025-01-02"},
    {"url": "https://else.example/4", "image": "https://e.com/have.jpg", "published": "2025-01-01"},
    {"url": "", "image": ""},
]


@pytest.mark.parametrize("enrich", [images.enrich_images, images.enrich_unique, images.enrich_few])
def test_enrichment(make_articles, pages, enrich):
    done = enrich(make_articles(MIXED), pages, ["bbc.com"], newest=["captured"])
    ordered = images.with_images_first(done, ARRIVAL).collect()
    assert [(r.position, r.had_image, r.image) for r in ordered] == [
        (3, True, "https://e.com/have.jpg"), (0, False, "https://cdn.example.com/new.jpg"), (1, False, ""),
        (2, False, ""), (4, False, "")]


def test_page_images_of_feed_entries_count_as_their_own(make_articles, pages):
    given = make_articles(MIXED).withColumn("from_feed", F.col("position") < 2)
    done = digest(given, pages, 5, domains=["bbc.com"], newest_page=["captured"]).collect()
    assert [(r.position, r.had_image) for r in done] == [(0, True), (3, True), (1, False), (2, False)]


def test_only_answered_pages_count(make_articles, pages):
    answered = pages.withColumn("status", F.when(F.col("captured") == 2, 404).otherwise(200))
    done = images.enrich_images(make_articles(MIXED[:1]), answered, ["bbc.com"], ["captured"])
    assert done.first().image == "https://cdn.example.com/old.jpg"


def test_pages_landed_twice_do_not_multiply_articles(make_articles, pages):
    done = images.enrich_images(make_articles(MIXED), pages.union(pages), ["bbc.com"])
    assert done.count() == len(MIXED)


def test_fallback_images(make_articles, pages, spark):
    defaults = spark.createDataFrame(
        [("example.com", "https://e.com/default.jpg"), ("example.com", "https://e.com/other.jpg")],
        "source string, default_image string")
    done = images.enrich_images(make_articles(MIXED), pages, ["bbc.com"], ["captured"], defaults)
    assert [r.image for r in done.orderBy("position").collect()] == [
        "https://cdn.example.com/new.jpg"] + ["https://e.com/default.jpg"] * 2 + [
        "https://e.com/have.jpg", "https://e.com/default.jpg"]


def test_coverage_and_gain(make_articles, pages):
    given = make_articles(MIXED[:1] + MIXED[3:4] * 3)
    (gain,) = statistics.coverage_gain(images.enrich_images(given, pages, ["bbc.com"], ["captured"])).collect()
    assert (gain.before_percent, gain.after_percent, gain.gain_points, gain.goal_met) == (75.0, 100.0, 25.0, True)
    overall = statistics.image_coverage(make_articles(MIXED)).where("overall").first()
    assert (overall.with_image, overall.total, overall.percent) == (1, 5, 20.0)
    empty = statistics.image_coverage(make_articles(MIXED).limit(0)).collect()
    assert [(r.total, r.percent) for r in empty] in ([(0, 0.0)], [])


@pytest.mark.parametrize("reread", [False, True])
@pytest.mark.parametrize("size,expected", [(2, [2, 0]), (None, [3, 2, 0, 1]), (0, [])])
def test_digest(make_articles, pages, size, expected, reread):
    given = make_articles([
        {"url": "https://bbc.com/1", "published": "2025-01-03"},
        {"url": "https://bbc.com/2", "published": "unknown"},
        {"url": "https://e.example/3", "published": "2025-01-04"},
        {"url": "https://e.example/4", "published": "2025-01-01", "image": "https://e.com/have.jpg"},
        {"url": "https://e.example/4", "published": "2025-01-09"},
        {"url": "", "published": "2025-01-10"},
    ])
    done = digest(given, pages, size, domains=["bbc.com"], newest_page=["captured"], reread=reread)
    if size is None:
        done = images.with_images_first(done, digest_order(ARRIVAL))
    done = done.collect()
    assert [row.position for row in done] == expected
    if size == 2:
        assert [row.image for row in done] == ["", "https://cdn.example.com/new.jpg"]


def test_reports(make_articles):
    given = make_articles([{"url": "u1", "tags": ["a", "b"], "summary": "s" * 151}, {"url": ""}, {"url": "u3"}])
    first, *_ = article_preview(given, ARRIVAL).orderBy("number").collect()
    assert (first.number, first.tags_text, first.summary_preview) == (1, "a, b", "s" * 150 + "...")
    assert [tuple(r) for r in url_list(given, ARRIVAL).orderBy("number").collect()] == [(1, "u1"), (2, "u3")]


def test_prepare(make_articles):
    given = make_articles([{"url": "https://example.com/a", "tags": None}, {"url": ""}, {"url": None}])
    (row,) = upsert.prepare(given, RUN_TS).collect()
    assert row.article_id == hashlib.md5(b"https://example.com/a").hexdigest()[:16] + "_20250113"
    assert (row.tags, row.published, row.scraped_at) == ([], "2025-01-13T15:30:00", RUN_TS)


def test_upsert_replaces_rows_and_keeps_ids(make_articles):
    stored = upsert.prepare(make_articles(SAMPLE), RUN_TS - timedelta(days=3))
    batch = make_articles([{"url": SAMPLE[0]["url"], "title": "Lost"}, {"url": SAMPLE[0]["url"], "title": "New"},
                           {"url": "https://example.com/3"}, {"url": ""}])
    merged = upsert.upsert(stored, upsert.prepare(batch, RUN_TS), ARRIVAL)
    found = {row.url[-1]: (row.title, row.article_id[-8:], row.scraped_at.day) for row in merged.collect()}
    assert found == {"1": ("New", "20250110", 13), "2": ("Two", "20250110", 10), "3": ("Title 2", "20250113", 13)}
    (outcome,) = upsert.upsert_outcome(stored, batch).collect()
    assert (outcome.inserted, outcome.updated, outcome.rejected, outcome.success) == (1, 2, 1, True)
    (nothing,) = upsert.upsert_outcome(stored, batch.where("url = ''")).collect()
    assert (nothing.inserted, nothing.updated, nothing.rejected, nothing.success) == (0, 0, 1, False)


@pytest.fixture
def aged(spark):
    ages = [0, 6, 7, 8, 29, 30, 31, 59, 60, 61, 90]
    rows = [(f"t{n}", f"u{n}", None if n > 60 else f"s{n % 3}", RUN_TS - timedelta(days=n)) for n in ages]
    return spark.createDataFrame(rows, "title string, url string, source string, scraped_at timestamp_ntz")


def test_age_buckets_and_sources(aged):
    (ages,) = statistics.age_buckets(aged, RUN_TS).collect()
    assert (ages.total_articles, ages.last_week, ages.last_month, ages.older) == (11, 3, 6, 2)
    top = statistics.top_sources(aged, 2).collect()
    assert [(r.source, r["count"]) for r in top] == [("s0", 4), ("s2", 3)]


def test_retention(aged):
    cutoff = retention.retention_cutoff(RUN_TS, 2)
    assert cutoff == RUN_TS - timedelta(days=60)
    assert retention.purge_keep(aged, cutoff).count() == 9
    (report,) = retention.purge_report(aged, cutoff).collect()
    assert (report.deleted_count, report.would_delete_count, report.total_remaining) == (2, None, 9)
    (dry,) = retention.purge_report(aged, cutoff, dry_run=True).collect()
    assert (dry.deleted_count, dry.would_delete_count, dry.total_remaining) == (None, 2, 11)
    assert [r.title for r in retention.purge_sample(aged, cutoff).collect()] == ["t90", "t61"]
    assert [r.title for r in retention.recent_articles(aged, RUN_TS, 7, 2).collect()] == ["t0", "t6"]


def test_empty_sources(spark, make_articles):
    configured = spark.createDataFrame([("example.com",), ("silent.example",)], "source string")
    silent = statistics.empty_sources(configured, make_articles(SAMPLE))
    assert [row.source for row in silent.collect()] == ["silent.example"]
