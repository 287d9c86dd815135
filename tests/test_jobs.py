"""Landed files, the two commands, and joins of measured size."""

import json
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsweave import jobs
from newsweave.functions.anchors import page_anchors
from newsweave.session import broadcast_if_small, materialize
from newsweave.sources.dims import source_dim
from newsweave.sources.feeds import unconfigured_feeds, with_source
from newsweave.sources.landing import read_documents

RSS = "<rss><channel>{}</channel></rss>"
ENTRY = "<item><title>{0}</title><link>https://techcrunch.com/{0}</link><pubDate>2025-01-{1:02}T00:00:00Z</pubDate></item>"


@pytest.fixture
def landed(spark, tmp_path):
    feed = RSS.format("\n".join(ENTRY.format(n, n) for n in range(1, 6)))
    answer = {"data": {"news_list": [{"title": "api", "source_url": "https://e.com/api", "created_at": "2025-01-09"}]}}
    for path, body in {
        "feeds/name=techcrunch/run1.xml": feed,
        "feeds/name=medium_pub_2/run1.xml": feed.replace("techcrunch.com/", "pub.example/"),
        "feeds/name=not_configured/run1.xml": feed,
        "feeds/name=wired/broken.xml": "<rss>",
        "api/category=science/page1.json": json.dumps(answer),
        "api/category=health/page1.json": "<html>",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    listing = '<a href="/p/listed">A listed story</a>'
    spark.createDataFrame([(1, "u", listing)], "page_id bigint, url string, html string").write.parquet(
        str(tmp_path / "listings"))
    meta = '<meta property="og:image" content="https://cdn.example.com/3.jpg">'
    spark.createDataFrame([(1, "https://techcrunch.com/3", meta)], "page_id bigint, url string, html string").write.parquet(
        str(tmp_path / "pages"))
    return tmp_path


def test_documents_are_whole_and_filed(spark, landed):
    documents = read_documents(spark, str(landed / "feeds"))
    assert documents.columns == ["name", "payload_id", "payload"]
    assert documents.count() == 4 and documents.select("payload_id").distinct().count() == 4
    filed = with_source(documents, source_dim(spark)).collect()
    assert {(row.name, row.cap) for row in filed} == {("techcrunch", 3), ("medium_pub_2", 2), ("wired", 3)}
    left_out = unconfigured_feeds(documents, source_dim(spark)).collect()
    assert [(row.name, row.reason) for row in left_out] == [("not_configured", "unconfigured")]


def test_daily_and_maintain_commands(spark, landed):
    folders = [part for name in ("feeds", "api", "listings", "pages", "snapshots", "store")
               for part in (f"--{name}", str(landed / name))]
    shown = jobs.run(spark, jobs.arguments(["daily", *folders, "--as-of", "2025-01-13T12:00:00", "--size", "5"]))
    urls = [row.url for row in shown["urls"].orderBy("number").collect()]
    assert urls == ["https://techcrunch.com/3", "https://medium.com/p/listed", "https://e.com/api",
                    "https://techcrunch.com/2", "https://pub.example/2"]
    assert shown["outcome"].first().inserted == 5
    assert {(row.source, row.reason) for row in shown["rejects"].collect()} == {
        ("not_configured", "unconfigured"), ("https://www.wired.com/feed/rss", "unreadable"), ("health", "unreadable")}
    assert shown["duplicates"].first().removed == 0 and shown["coverage"].where("overall").first().with_image == 1
    assert "wired" in {row.name for row in shown["empty_sources"].collect()}
    saved = spark.read.json(str(landed / "snapshots")).where("image <> ''")
    assert [row.image for row in saved.collect()] == ["https://cdn.example.com/3.jpg"]

    def maintain(*options):
        return jobs.run(spark, jobs.arguments(["maintain", "--store", str(landed / "store"), *options]))

    later = ["--as-of", "2025-04-01T00:00:00"]
    assert maintain("--stats", *later)["ages"].first().older == 5
    dry = maintain("--dry-run", *later)
    assert dry["purge"].first().would_delete_count == 5 and dry["sample"].count() == 5
    assert maintain("--months", "3", *later)["purge"].first().deleted_count == 0
    assert maintain(*later)["purge"].first().deleted_count == 5
    assert maintain("--stats", *later)["ages"].first().total_articles == 0


def test_broadcast_only_when_small(spark):
    keys = materialize(spark.range(1000).select(F.col("id").cast("string").alias("k")))
    table = spark.range(10).select(F.col("id").cast("string").alias("k"))

    def hinted(limit):
        joined = table.join(broadcast_if_small(keys, limit), "k")
        return "strategy=broadcast" in joined._jdf.queryExecution().analyzed().toString()

    assert hinted(100_000) and not hinted(10_000)


def test_anchor_helper_travels_with_the_job():
    """The helper runs in a Python that cannot import this package."""
    load = "import pickle, sys; print(pickle.load(sys.stdin.buffer)('<a href=x>y</a>'))"
    done = subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(page_anchors),
                          capture_output=True, cwd="/", env={"PYTHONPATH": ""}, check=True)
    assert b"'text': 'y'" in done.stdout


def test_run_time_defaults_to_now():
    options = jobs.arguments(["maintain", "--store", "s"])
    assert abs((datetime.now() - options.as_of).total_seconds()) < 86_400 and options.months == 2
