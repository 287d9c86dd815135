"""Registered queries: every operator over the whole given tables.

Arrays leave as joined text and times as text of fixed form, so that results
compare the same way in any engine.
"""

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import AS_OF, CAP, DOMAINS, OLD_DAYS, RETENTION_DAYS, RUN_TS, SPLIT
from newsweave import settings
from newsweave.functions.dates import normalize_published
from newsweave.functions.html import first_image
from newsweave.functions.text import present
from newsweave.functions import urls
from newsweave.operators import images, ranking, retention, statistics, upsert
from newsweave.plans import daily_run as daily
from newsweave.plans import digest as digests
from newsweave.plans import reports
from newsweave.session import names_in, scratch_path, write_out
from newsweave.sources import api, dims, feeds, listing, sinks
from newsweave.sources.backups import SnapshotBackups
from newsweave.sources.page_images import PageImages
from newsweave.sources.store import ArticleStore
from newsweave.streaming import articles as streaming
from newsweave.streaming.firsts import DailyCounts, firsts_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CUTOFF = AS_OF - timedelta(days=RETENTION_DAYS)
# Bytes of text in a file that lands.
LANDED_BYTES = 64 << 20
ARRIVAL = ["source_rank", "payload_id", "position"]
DETAIL = ["title", "url", "published", "summary", "source", "tags_text", "image"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def moment(column: str) -> Column:
    plain = F.col(column).cast("string")
    fraction = F.rpad(F.substring(plain, 21, 6), 6, "0")
    return F.concat(F.substring(plain, 1, 19), F.lit("."), fraction).alias(column)


def placed(df: DataFrame) -> DataFrame:
    """The rows with their place in the order they come in."""
    counted = df.withColumn("_at", F.monotonically_increasing_id())
    return ranking.number_rows(counted, ["_at"], "place").drop("_at")


def tags_text(df: DataFrame) -> DataFrame:
    return df.withColumn("tags_text", F.array_join("tags", "|"))


def _stored(spark, sf_dir) -> DataFrame:
    early = views.articles(spark, sf_dir).where(retention.scraped_before(SPLIT))
    return ranking.keep_last(upsert.prepare(early), ["scraped_at", "ord"])


def _incoming(spark, sf_dir) -> DataFrame:
    return views.articles(spark, sf_dir).where(retention.scraped_since(SPLIT))


# Order, duplicates and caps


@query
def dedup_first(spark, sf_dir):
    kept = ranking.keep_first(views.articles(spark, sf_dir), ["ord"])
    return kept.select("ord", "url", "title", "source")


@query
def source_cap(spark, sf_dir):
    capped = ranking.cap_per_source(views.articles(spark, sf_dir), ["source"], ["ord"], CAP)
    return capped.select("ord", "source", "title", "url")


@query
def latest_by_published(spark, sf_dir):
    dated = ranking.with_published_time(views.articles(spark, sf_dir)).select(
        "ord", "published", "published_ts"
    )
    ordered = ranking.newest_first(dated, ["ord"])
    return placed(ordered.select("ord", "published", moment("published_ts")))


@query
def number_articles(spark, sf_dir):
    dated = ranking.with_published_time(views.articles(spark, sf_dir)).select("ord", "published_ts")
    order = [F.desc_nulls_last("published_ts"), F.col("ord")]
    return ranking.number_rows(dated, order, "place").select("place", "ord")


@query
def top_n_digest(spark, sf_dir):
    chosen = digests.digest(
        views.articles(spark, sf_dir),
        views.pages_meta(spark, sf_dir),
        arrival=["ord"],
        domains=DOMAINS,
        reread=True,
    )
    return placed(chosen.select("ord", "title", "url", "published", "image", "had_image"))


@query
def top_n_by_candidates(spark, sf_dir):
    """The same digest, its cut found among the addresses that may make it."""
    chosen = digests.digest(
        views.articles(spark, sf_dir),
        views.pages_meta(spark, sf_dir),
        arrival=["ord"],
        domains=DOMAINS,
        reread=True,
        by_candidates=True,
    )
    return placed(chosen.select("ord", "title", "url", "published", "image", "had_image"))


# Images


@query
def image_valid(spark, sf_dir):
    return views.articles(spark, sf_dir).select(
        "ord", "image", urls.is_valid_image_url(F.col("image")).alias("valid")
    )


@query
def image_normalize(spark, sf_dir):
    return views.articles(spark, sf_dir).select(
        "ord", urls.normalize_image_url(F.col("image")).alias("image")
    )


@query
def html_first_image(spark, sf_dir):
    return views.image_texts(spark, sf_dir).select(
        "doc_id", first_image(F.col("html")).alias("image")
    )


@query
def page_meta_image(spark, sf_dir):
    return images.page_images(views.pages_meta(spark, sf_dir), DOMAINS)


@query
def page_image_lookup(spark, sf_dir):
    """Images of pages from a table kept over two runs, of which the second parses none."""
    pages = views.pages_meta(spark, sf_dir)
    kept = PageImages(spark, scratch_path(spark, "page-images"), ["page_id"], domains=DOMAINS)
    parsed = [kept.extend(pages) for _ in range(2)]
    return images.page_images(kept.pages(pages), DOMAINS).withColumns(
        {"parsed_first": F.lit(parsed[0]).cast("long"), "parsed_again": F.lit(parsed[1]).cast("long")}
    )


@query
def srcset_first(spark, sf_dir):
    srcset = F.concat(
        F.lit("  "), "image", F.lit(" 1x, https://cdn.example.com/"), "source", F.lit(".jpg 2x")
    )
    return views.articles(spark, sf_dir).select("ord", urls.srcset_first(srcset).alias("candidate"))


@query
def enrich_images(spark, sf_dir):
    enriched = images.enrich_images(
        views.articles(spark, sf_dir), views.pages_meta(spark, sf_dir), DOMAINS
    )
    narrow = enriched.select("ord", "url", "image", "had_image")
    return placed(images.with_images_first(narrow, ["ord"]))


@query
def fallback_image(spark, sf_dir):
    """Default images by source, two for every third supplier."""
    suppliers = views.table(spark, sf_dir, "supplier")
    again = suppliers.where(F.col("s_suppkey") % 3 == 0).withColumn("s_nationkey", F.col("s_nationkey") + 100)
    suppliers = suppliers.select("s_suppkey", "s_nationkey").unionByName(again.select("s_suppkey", "s_nationkey"))
    nation = F.lpad(F.col("s_nationkey").cast("string"), 3, "0")
    defaults = suppliers.select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("source"),
        F.concat(F.lit("https://cdn.example.com/default/"), nation).alias("default_image"),
    )
    enriched = images.enrich_images(
        views.articles(spark, sf_dir), views.pages_meta(spark, sf_dir), DOMAINS, defaults=defaults
    )
    return enriched.select("ord", "image")


@query
def image_coverage(spark, sf_dir):
    return statistics.image_coverage(views.articles(spark, sf_dir))


@query
def coverage_gain(spark, sf_dir):
    enriched = images.enrich_images(
        views.articles(spark, sf_dir), views.pages_meta(spark, sf_dir), DOMAINS
    )
    return statistics.coverage_gain(enriched)


# Text and links


@query
def source_host(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", urls.source_host(F.col("url")).alias("host"))


@query
def href_absolutize(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    found = views.listing_pages(spark, sf_dir).select(
        "page_id", F.posexplode(links).alias("position", "href")
    )
    resolved = urls.absolutize_href(F.col("href"), settings.LISTING_BASE)
    return found.withColumn("url", resolved).where(F.col("url").isNotNull())


@query
def article_preview(spark, sf_dir):
    return reports.article_preview(views.articles(spark, sf_dir), ["ord"])


@query
def url_list(spark, sf_dir):
    return reports.url_list(views.articles(spark, sf_dir), ["ord"])


@query
def filter_source(spark, sf_dir):
    wanted = F.col("source") == "src3.example.com"
    return views.articles(spark, sf_dir).where(wanted).select("ord", "title", "source")


@query
def published_normalize(spark, sf_dir):
    return views.articles(spark, sf_dir).select(
        "ord", normalize_published(F.col("published"), RUN_TS).alias("published")
    )


# Sources


@query
def feed_ingest_xml(spark, sf_dir):
    found = feeds.feed_articles(views.feed_payloads(spark, sf_dir))
    return tags_text(found).select(*ARRIVAL, *DETAIL)


@query
def feed_image_cascade(spark, sf_dir):
    everything = views.feed_payloads(spark, sf_dir).withColumn("cap", F.lit(2**31 - 1))
    found = feeds.feed_articles(everything).select("payload_id", "position", "url", "image")
    looked_up = images.enrich_images(found, views.pages_meta(spark, sf_dir), DOMAINS)
    return looked_up.drop("had_image")


@query
def feed_source_config(spark, sf_dir):
    """Feed documents filed under configured source names, with the configured caps."""
    names = dims.source_dim(spark).select("name", (F.col("source_rank")).alias("_rank"))
    payloads = views.feed_payloads(spark, sf_dir)
    filed = payloads.withColumn("_rank", F.col("source_rank") * 2 % 37).select(
        "_rank", "payload_id", "payload"
    ).join(F.broadcast(names), "_rank").select("name", "payload_id", "payload")
    found = feeds.feed_articles(feeds.with_source(filed, dims.source_dim(spark)))
    return found.select(*ARRIVAL, "source", "title", "url")


@query
def feed_rejects(spark, sf_dir):
    return feeds.feed_rejects(views.feed_payloads(spark, sf_dir))


@query
def api_parse(spark, sf_dir):
    payloads = views.api_payloads(spark, sf_dir)
    found = api.api_articles(payloads, dims.category_dim(spark), RUN_TS, override=2**31 - 1)
    return tags_text(found).select(
        "payload_id", "position", *DETAIL, "inshorts_id", "original_source"
    )


@query
def api_category_cap(spark, sf_dir):
    payloads = views.api_payloads(spark, sf_dir)
    found = api.api_articles(payloads, dims.category_dim(spark), RUN_TS)
    return found.select(*ARRIVAL, "inshorts_id", "url")


@query
def api_rejects(spark, sf_dir):
    payloads = views.api_payloads(spark, sf_dir)
    return api.api_rejects(api.api_items(api.with_category_cap(payloads, dims.category_dim(spark))))


@query
def unreadable_responses(spark, sf_dir):
    return api.unreadable_responses(views.api_payloads(spark, sf_dir))


@query
def unconfigured_feeds(spark, sf_dir):
    """Feed documents of which some are filed under names that no source has."""
    rank = F.col("source_rank")
    name = F.when(rank % 5 == 0, F.concat(F.lit("unknown"), rank.cast("string"))).otherwise("techcrunch")
    filed = views.feed_payloads(spark, sf_dir).select(name.alias("name"), "payload_id", "payload")
    return feeds.unconfigured_feeds(filed, dims.source_dim(spark))


@query
def category_cap_window(spark, sf_dir):
    """The configured cap per category over a table of already parsed items."""
    names = F.array(*[F.lit(name) for name in views.CATEGORIES])
    filed = views.articles(spark, sf_dir).select(
        "ord", "title", names[(F.col("ord") % len(views.CATEGORIES)).cast("int")].alias("category")
    )
    known = F.broadcast(dims.category_dim(spark))
    limited = filed.join(known, "category", "left").withColumn(
        "cap", F.coalesce("max_limit", F.lit(settings.UNKNOWN_CATEGORY_CAP))
    )
    capped = ranking.cap_per_source(limited, ["category"], ["ord"], F.col("cap"))
    return capped.select("category", "ord", "title")


@query
def trending_topics(spark, sf_dir):
    return api.trending_topics(views.topic_payloads(spark, sf_dir))


@query
def topic_counts(spark, sf_dir):
    return api.topic_counts(api.trending_topics(views.topic_payloads(spark, sf_dir)))


@query
def link_harvest(spark, sf_dir):
    links = listing.harvest_links(views.listing_pages(spark, sf_dir), settings.LISTING_BASE)
    return links.select("page_id", "position", "title", "url")


@query
def listing_image(spark, sf_dir):
    links = listing.harvest_links(views.listing_pages(spark, sf_dir), settings.LISTING_BASE)
    return links.select("page_id", "position", "image")


@query
def listing_ingest(spark, sf_dir):
    found = listing.listing_articles(views.listing_pages(spark, sf_dir), RUN_TS, source_rank=36)
    return tags_text(found).select(*ARRIVAL, *DETAIL)


@query
def union_sources(spark, sf_dir):
    a = views.articles(spark, sf_dir).select("title", "url", "source", "image")
    p = views.pages_meta(spark, sf_dir).select("url", F.lit("pages").alias("source"))
    return digests.union_sources([a, p])


def _collected(spark, sf_dir) -> DataFrame:
    return digests.collect_articles(
        views.feed_payloads(spark, sf_dir),
        views.api_payloads(spark, sf_dir),
        views.listing_pages(spark, sf_dir),
        RUN_TS,
    )


@query
def daily_digest(spark, sf_dir):
    """The flagship: landed payloads to the newest unique articles with images."""
    chosen = digests.digest(_collected(spark, sf_dir), views.pages_meta(spark, sf_dir), domains=DOMAINS)
    return placed(tags_text(chosen).select(*ARRIVAL, *DETAIL, "had_image"))


@query
def full_digest(spark, sf_dir):
    """The same over all unique articles: no cut."""
    chosen = digests.digest(
        _collected(spark, sf_dir), views.pages_meta(spark, sf_dir), size=None, domains=DOMAINS
    )
    return tags_text(chosen).select(*ARRIVAL, "title", "url", "published", "image", "had_image")


# Store


@query
def article_id(spark, sf_dir):
    ready = upsert.prepare(views.articles(spark, sf_dir), RUN_TS)
    return ready.select("ord", "article_id", moment("scraped_at"))


@query
def type_repair(spark, sf_dir):
    broken = views.articles(spark, sf_dir).withColumn(
        "tags", F.when(F.col("ord") % 4 != 0, F.col("tags"))
    )
    ready = tags_text(upsert.prepare(broken, RUN_TS))
    return ready.select("ord", "published", "tags_text")


@query
def upsert_current(spark, sf_dir):
    incoming = upsert.prepare(_incoming(spark, sf_dir))
    merged = upsert.upsert(_stored(spark, sf_dir), incoming, ["scraped_at", "ord"])
    return merged.select("url", "ord", "title", "article_id", moment("scraped_at"))


@query
def upsert_outcome(spark, sf_dir):
    stored = _stored(spark, sf_dir).select("url")
    return upsert.upsert_outcome(stored, _incoming(spark, sf_dir).select("url"))


@query
def store_round_trip(spark, sf_dir):
    """Two batches saved to a store on disk, the second one twice."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(_stored(spark, sf_dir), "1", ["ord"])
    store.save(_incoming(spark, sf_dir), "2", ["scraped_at", "ord"])
    store.save(_incoming(spark, sf_dir), "2", ["scraped_at", "ord"])
    return store.current().select("url", "title", "article_id", moment("scraped_at"))


@query
def store_last_wins(spark, sf_dir):
    """Later saves with equal and with older times, under batch names that sort before."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    a = views.articles(spark, sf_dir).select("ord", "url", "title", "scraped_at")
    store.save(a, "9", ["scraped_at", "ord"])
    again = a.where(F.col("ord") % 2 == 0).withColumn("title", F.concat(F.lit("again "), "title"))
    store.save(again, "10", ["scraped_at", "ord"])
    older = a.where(F.col("ord") % 3 == 0).withColumns(
        {"title": F.concat(F.lit("older "), "title"), "scraped_at": F.expr("scraped_at - interval 90 days")}
    )
    store.save(older, "1", ["scraped_at", "ord"])
    return store.current().select("url", "title", moment("scraped_at"))


@query
def store_purge(spark, sf_dir):
    """What a saved, purged and compacted store still holds."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(_stored(spark, sf_dir), "1", ["ord"])
    store.save(_incoming(spark, sf_dir), "2", ["scraped_at", "ord"])
    store.purge(AS_OF, cutoff=CUTOFF)
    kept = store.compact(scratch_path(spark, "compacted"))
    return kept.log().select("url", "article_id", moment("scraped_at"))


@query
def store_known_addresses(spark, sf_dir):
    """What a saved store knows of the addresses of the next batch, from its index."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(_stored(spark, sf_dir), "1", ["ord"])
    batch, _ = write_out(_incoming(spark, sf_dir).select("url"), "incoming")
    return store.index.near(batch).select("url", "article_id", "source", moment("scraped_at"), "saved")


@query
def store_changes(spark, sf_dir):
    """Current articles by time and source, from what two saves, a repeated one and a purge changed."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(_stored(spark, sf_dir), "1", ["ord"])
    store.save(_incoming(spark, sf_dir), "2", ["scraped_at", "ord"])
    store.save(_stored(spark, sf_dir), "1", ["ord"])
    store.purge(AS_OF, cutoff=CUTOFF)
    return store.counts().select(moment("scraped_at"), "source", "articles")


@query
def purge_keep(spark, sf_dir):
    kept = retention.purge_keep(views.articles(spark, sf_dir), CUTOFF)
    return kept.select("ord", "url", moment("scraped_at"))


@query
def purge_report(spark, sf_dir):
    return retention.purge_report(views.articles(spark, sf_dir), CUTOFF)


@query
def purge_dry_run(spark, sf_dir):
    return retention.purge_report(views.articles(spark, sf_dir), CUTOFF, dry_run=True)


@query
def purge_sample(spark, sf_dir):
    sample = retention.purge_sample(views.articles(spark, sf_dir), CUTOFF, ties=("ord",))
    return sample.select("title", "source", moment("scraped_at"))


@query
def recent_articles(spark, sf_dir):
    unique = ranking.keep_last(views.articles(spark, sf_dir), ["scraped_at", "ord"])
    recent = retention.recent_articles(unique, AS_OF)
    return placed(recent.select("url", "title", moment("scraped_at")))


@query
def store_recent(spark, sf_dir):
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(views.articles(spark, sf_dir), "1", ["scraped_at", "ord"])
    return placed(store.recent(AS_OF).select("url", "title", moment("scraped_at")))


@query
def store_statistics(spark, sf_dir):
    """Top sources of a saved store, each with the age counts of the whole."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(views.articles(spark, sf_dir), "1", ["scraped_at", "ord"])
    shown = daily.store_statistics(store, AS_OF)
    ages = [
        shown["ages"].select(name).scalar().alias(name)
        for name in ("total_articles", "last_week", "last_month", "older")
    ]
    return shown["sources"].select("*", *ages)


@query
def json_snapshot(spark, sf_dir):
    a = views.articles(spark, sf_dir).drop("ord")
    target = sinks.save_json(a, scratch_path(spark, "snapshots"), AS_OF.date())
    schema = "title string, url string, summary string, tags array<string>, scraped_at string"
    return tags_text(spark.read.schema(schema).json(target)).drop("tags")


@query
def snapshot_backup(spark, sf_dir):
    a = views.articles(spark, sf_dir)
    root = scratch_path(spark, "snapshots")
    sinks.save_json(a, root, AS_OF.date())
    sinks.save_json(a.where(retention.scraped_before(CUTOFF)), root, CUTOFF.date())
    return sinks.backup(spark, root, scratch_path(spark, "backups"), AS_OF)


@query
def backup_incremental(spark, sf_dir):
    """Three backups: the second finds nothing to copy, the third one changed snapshot; and what each restores."""
    # Read three times, so joined once.
    a, _ = write_out(views.articles(spark, sf_dir), "articles")
    root, kept = scratch_path(spark, "snapshots"), SnapshotBackups(spark, scratch_path(spark, "backups"))
    old = a.where(retention.scraped_before(CUTOFF))
    sinks.save_json(a, root, AS_OF.date())
    sinks.save_json(old, root, CUTOFF.date())
    checks = []
    for n in range(3):
        if n == 2:
            sinks.save_json(a.where(retention.scraped_since(CUTOFF)), root, CUTOFF.date())
        at = AS_OF + timedelta(hours=n)
        check = kept.take(root, at)
        restored = kept.restore(at).agg(F.count("*").alias("restored_rows"))
        checks.append(check.select(F.lit(n).alias("backup"), "*", restored.scalar().alias("restored_rows")))
    return digests.union_sources(checks)


@query
def daily_job(spark, sf_dir):
    """The whole daily run over a filled store, told by its counts."""
    store = ArticleStore(spark, scratch_path(spark, "store"))
    store.save(_stored(spark, sf_dir), "1", ["ord"])
    shown = daily.daily_run(
        _incoming(spark, sf_dir),
        views.pages_meta(spark, sf_dir),
        store,
        scratch_path(spark, "snapshots"),
        RUN_TS,
        arrival=["ord"],
        domains=DOMAINS,
        purge_months=1,
    )
    counts = shown["outcome"].select("inserted", "updated", "rejected")
    return counts.select(
        "*",
        shown["purge"].select("deleted_count").scalar().alias("deleted_count"),
        shown["total"].select("total_articles").scalar().alias("total_articles"),
        shown["urls"].agg(F.count("*")).scalar().alias("listed"),
        shown["purge"].select("success").scalar().alias("purged"),
        shown["duplicates"].select("removed").scalar().alias("removed"),
        shown["coverage"].where("overall").select("with_image").scalar().alias("with_image"),
    )


# Statistics


@query
def article_count(spark, sf_dir):
    return statistics.article_count(views.articles(spark, sf_dir))


@query
def age_buckets(spark, sf_dir):
    return statistics.age_buckets(views.articles(spark, sf_dir), AS_OF, old_days=OLD_DAYS)


@query
def top_sources(spark, sf_dir):
    return statistics.top_sources(views.articles(spark, sf_dir))


@query
def dedup_metrics(spark, sf_dir):
    return statistics.dedup_metrics(views.articles(spark, sf_dir))


@query
def empty_sources(spark, sf_dir):
    """Publishers, one per part, that delivered no article with an address."""
    sources = views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("src"), F.col("p_partkey").cast("string"), F.lit(".example.com")).alias("source")
    )
    delivered = views.articles(spark, sf_dir).where(present(F.col("url")))
    return statistics.empty_sources(sources, delivered)


def _filed_categories(spark, sf_dir) -> DataFrame:
    """Configured limit and delivered items of every category with payloads."""
    items = api.api_items(
        api.with_category_cap(views.api_payloads(spark, sf_dir), dims.category_dim(spark), 2**31 - 1)
    )
    delivered = items.groupBy("category").agg(F.count("*").alias("delivered"))
    return delivered.join(F.broadcast(dims.category_dim(spark)), "category")


@query
def category_capacity(spark, sf_dir):
    return statistics.category_capacity(_filed_categories(spark, sf_dir))


@query
def category_priority(spark, sf_dir):
    return statistics.categories_by_priority(_filed_categories(spark, sf_dir))


@query
def daily_arrivals(spark, sf_dir):
    counted = statistics.daily_arrivals(views.articles(spark, sf_dir))
    return counted.withColumn("day", F.col("day").cast("string"))


# Streaming


def _landing_files(spark, sf_dir, least: int = 4) -> int:
    """Files that the articles land in: more of them with more text, none larger for it."""
    text = views.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return least * max(1, -(-text // (least * LANDED_BYTES)))


def _landed_articles(spark, sf_dir, files: int = 4) -> DataFrame:
    """The articles as files in a landing folder, read as a stream of two micro-batches."""
    folder = scratch_path(spark, "landed")
    landing = views.articles(spark, sf_dir)
    files = _landing_files(spark, sf_dir, files)
    landing.repartition(files, "ord").write.parquet(folder)
    return streaming.landed(spark, folder, landing.schema, files_per_trigger=files // 2)


@query
def stream_ingest(spark, sf_dir):
    folder, out = scratch_path(spark, "landed"), scratch_path(spark, "ingested")
    payloads = views.feed_payloads(spark, sf_dir)
    payloads.write.parquet(folder)
    stream = streaming.landed(spark, folder, payloads.schema)
    streaming.write_available(
        streaming.stream_feed_articles(stream), out, scratch_path(spark, "progress")
    )
    return spark.read.parquet(out).select(*ARRIVAL, "title", "url", "image")


@query
def stream_dedup(spark, sf_dir):
    out = scratch_path(spark, "unique")
    # The state's shuffles carry no more than is asked of them.
    landed = _landed_articles(spark, sf_dir).select("ord", "url", "title", "source", "scraped_at")
    unique = streaming.stream_unique(landed, "60 days", ["ord"])
    kept = unique.select("ord", "url", "title", "source")
    streaming.write_available(kept, out, scratch_path(spark, "progress"))
    # Any copy may pass, but it passes whole.
    a = views.articles(spark, sf_dir).select("ord", "url", "title", "source", F.lit(True).alias("whole"))
    read = spark.read.schema(kept.schema).parquet(out)
    return read.join(a, ["ord", "url", "title", "source"], "left").select(
        "url", F.coalesce("whole", F.lit(False)).alias("whole")
    )


@query
def stream_first_arrivals(spark, sf_dir):
    """The table of first arrivals per address that a stream keeps, whatever file lands first."""
    out = scratch_path(spark, "firsts")
    firsts_available(_landed_articles(spark, sf_dir), out, scratch_path(spark, "progress"), "60 days", ["ord"])
    return spark.read.parquet(out).select("ord", "url", "title", "source")


@query
def stream_late_rows(spark, sf_dir):
    """Daily counts of a stream whose older half lands last, with the rows that came too late to count."""
    folder, progress = scratch_path(spark, "landed"), scratch_path(spark, "progress")
    a = views.articles(spark, sf_dir)
    counts = DailyCounts(spark, scratch_path(spark, "counts"), timedelta(days=20))
    for part in (a.where(retention.scraped_since(SPLIT)), a.where(retention.scraped_before(SPLIT))):
        # A half lands in as many files as it has, and is one micro-batch.
        part.write.mode("append").parquet(folder)
        files = len(names_in(spark, folder))
        counts.update(streaming.landed(spark, folder, a.schema, files_per_trigger=files), progress)
    late = counts.late(a).groupBy(F.to_date("scraped_at").alias("day"), "source").agg(F.count("*").alias("late"))
    both = counts.counts().withColumn("late", F.lit(0)).unionByName(late.withColumn("articles", F.lit(0)))
    summed = both.groupBy("day", "source").agg(F.sum("articles").alias("articles"), F.sum("late").alias("late"))
    return summed.withColumn("day", F.col("day").cast("string"))


@query
def stream_upsert(spark, sf_dir):
    store = ArticleStore(spark, scratch_path(spark, "store"))
    streaming.upsert_available(
        _landed_articles(spark, sf_dir), store, ["scraped_at", "ord"], scratch_path(spark, "progress")
    )
    return store.current().select("url", "title", moment("scraped_at"))


@query
def stream_daily_arrivals(spark, sf_dir):
    """Daily counts kept up to date as articles land."""
    out = scratch_path(spark, "arrivals")
    counts = streaming.stream_daily_arrivals(_landed_articles(spark, sf_dir), "60 days")
    streaming.daily_arrivals_available(counts, out, scratch_path(spark, "progress"))
    counted = streaming.read_daily_arrivals(spark, out)
    return counted.withColumn("day", F.col("day").cast("string"))
