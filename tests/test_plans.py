"""The physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from newsweave.operators import images, ranking, upsert
from newsweave.plans.digest import digest, newest_unique
from newsweave.sources import feeds, listing

ARRIVAL = ["source_rank", "payload_id", "position"]


def plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Articles and pages as Parquet, large enough by statistics not to be broadcast."""
    root = tmp_path_factory.mktemp("tables")
    articles = spark.range(2000).select(
        F.concat(F.lit("https://bbc.com/"), (F.col("id") % 700).cast("string")).alias("url"),
        F.lit("t").alias("title"), F.lit("2025-01-01").alias("published"), F.lit("s").alias("summary"),
        F.lit("src").alias("source"), F.array(F.lit("x")).alias("tags"), F.lit("").alias("image"),
        F.lit(0).alias("source_rank"), F.col("id").alias("payload_id"), F.lit(0).alias("position"),
        F.lit("id").alias("article_id"))
    articles.write.parquet(str(root / "articles"))
    articles.select("url", F.lit("<p>").alias("html")).write.parquet(str(root / "pages"))
    return spark.read.parquet(str(root / "articles")), spark.read.parquet(str(root / "pages"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(text):
    return text.split("\n(1)")[0].count("Exchange (")


def test_dedupe_and_caps_trim_before_the_shuffle(table):
    articles, _ = table
    for frame in (ranking.keep_first(articles, ARRIVAL),
                  ranking.cap_per_source(articles, ["source"], ARRIVAL, 3),
                  ranking.cap_per_source(articles, ["source"], ARRIVAL, F.length("title"), 5)):
        text = plan(frame)
        assert text.count("WindowGroupLimit (") == 2 and shuffles(text) == 1


def test_blank_addresses_are_filtered_in_the_scan(table):
    assert "PushedFilters: [IsNotNull(url), Not(EqualTo(url,))]" in plan(ranking.keep_first(table[0], ARRIVAL))


def test_top_n_is_not_a_full_sort(table):
    top = ranking.newest_first(ranking.with_published_time(table[0]), ARRIVAL).limit(50)
    text = plan(top)
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_enriching_unique_articles_adds_no_shuffle_of_them(table, no_broadcast):
    articles, pages = table
    text = plan(images.enrich_unique(ranking.keep_first(articles, ARRIVAL), pages, ["bbc.com"]))
    assert shuffles(text) == 2 and "NestedLoop" not in text and "Cartesian" not in text


def test_only_articles_worth_a_look_are_joined(table, no_broadcast):
    articles, pages = table
    text = plan(images.enrich_images(articles, pages, ["bbc.com"]))
    assert shuffles(text) <= 1 and "Union" in text


def test_small_batches_are_broadcast_to_the_store(table):
    articles, _ = table
    merged = upsert.upsert(articles, articles.limit(5), ARRIVAL)
    text = plan(merged)
    assert "SortMergeJoin" not in text and "NestedLoop" not in text


def test_ingest_has_no_shuffle(spark):
    payloads = spark.createDataFrame(
        [], "feed_url string, source_rank int, cap int, payload_id bigint, payload string")
    assert shuffles(plan(feeds.feed_articles(payloads))) == 0
    pages = spark.createDataFrame([], "page_id bigint, html string")
    assert shuffles(plan(listing.harvest_links(pages, "https://e.com", 5))) == 0


def test_digest_reread_shuffles_no_text(table):
    articles, pages = table
    text = plan(digest(articles, pages, arrival=ARRIVAL, domains=["bbc.com"], reread=True))
    for block in text.split("\n\n"):
        if "Exchange" in block.split("\n")[0] and "hashpartitioning" in block:
            assert "summary" not in block


def test_page_scan_reads_two_columns(table):
    text = plan(images.page_images(table[1], ["bbc.com"]))
    assert "ReadSchema: struct<url:string,html:string>" in text


@pytest.mark.parametrize("size", [1, 200_000])
def test_two_files_with_one_arrival_id(spark, size):
    """Rows of another file that met the same arrival do not come with a chosen one."""
    rows = [("https://a/1", "2025-01-02", 7, 1), ("https://b/1", "2025-01-01", 7, 1), ("https://b/1", "2025-01-01", 9, 1)]
    articles = spark.createDataFrame(rows, "url string, published string, payload_id long, position long")
    got = newest_unique(articles, size, ["payload_id", "position"], False).collect()
    assert sorted(r.url for r in got) == ["https://a/1", "https://b/1"][: min(size, 2)]


def test_first_of_each_address_with_one_arrival_id(spark):
    """The later row of an address stays out though a chosen row shares its arrival."""
    rows = [("https://a/1", "2025-01-02", 7, 1), ("https://b/1", "2025-01-01", 7, 1), ("https://b/1", "2025-01-01", 5, 1)]
    articles = spark.createDataFrame(rows, "url string, published string, payload_id long, position long")
    got = newest_unique(articles, None, ["payload_id", "position"], False).collect()
    assert sorted((r.url, r.payload_id) for r in got) == [("https://a/1", 7), ("https://b/1", 5)]
