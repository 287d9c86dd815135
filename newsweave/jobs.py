"""The two jobs as commands for spark-submit.

    newsweave/jobs.py daily --feeds F --api A --listings L --pages P --store S --snapshots J
    newsweave/jobs.py maintain --store S [--months N] [--dry-run] [--stats] [--compact FOLDER]

Payload folders are laid out as ``newsweave.sources.landing`` describes; listings
and pages are Parquet tables ``page_id, url, html``. Pages may have a time column, named
by --newest-page, by which the latest of an address counts. With --page-images only pages that
landed since the last run are parsed. After --compact the store goes on
in the new folder.
"""

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.operators.retention import purge_sample, retention_cutoff
from newsweave.operators.statistics import article_count
from newsweave.plans.daily_run import daily_run, store_statistics
from newsweave.plans.digest import collect_articles, union_sources
from newsweave.sources.api import unreadable_responses
from newsweave.sources.dims import source_dim
from newsweave.sources.feeds import feed_rejects, unconfigured_feeds, with_source
from newsweave.sources.landing import read_documents
from newsweave.sources.listing import listing_rejects
from newsweave.sources.page_images import PageImages
from newsweave.sources.store import ArticleStore


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    daily = jobs.add_parser("daily", help="build, save and show the digest")
    for folder in ("feeds", "api", "listings", "pages", "snapshots"):
        daily.add_argument(f"--{folder}", required=True)
    daily.add_argument("--size", type=int, default=settings.DIGEST_SIZE)
    daily.add_argument("--no-cleanup", action="store_true", help="keep expired articles")
    daily.add_argument("--newest-page", nargs="*", default=[], help="columns that order pages")
    daily.add_argument("--page-images", metavar="FOLDER", help="keep the images found in pages there")
    daily.add_argument("--page-key", nargs="*", default=["page_id"], help="columns that name a landed page")
    daily.add_argument("--parse-rfc822", action="store_true", help="read mail dates of feeds")
    maintain = jobs.add_parser("maintain", help="purge or describe the store")
    maintain.add_argument("--dry-run", action="store_true")
    maintain.add_argument("--stats", action="store_true")
    maintain.add_argument("--compact", metavar="FOLDER", help="write the current rows there")
    for job in (daily, maintain):
        job.add_argument("--store", required=True)
        job.add_argument("--months", type=int, default=settings.RETENTION_MONTHS)
        job.add_argument("--as-of", type=_moment, default=now, help="UTC time of the run")
    return parser.parse_args(given)


def run(spark: SparkSession, options: argparse.Namespace) -> dict:
    """Run the chosen job; the returned frames are what it has to show."""
    store = ArticleStore(spark, options.store)
    if options.job == "daily":
        filed, configured = read_documents(spark, options.feeds), source_dim(spark)
        feeds, api = with_source(filed, configured), read_documents(spark, options.api)
        listings = spark.read.parquet(options.listings)
        pages = spark.read.parquet(options.pages)
        if options.page_images:
            kept = PageImages(spark, options.page_images, options.page_key, options.newest_page)
            kept.extend(pages)
            pages = kept.pages(pages)
        shown = daily_run(
            collect_articles(feeds, api, listings, options.as_of),
            pages,
            store,
            options.snapshots,
            options.as_of,
            options.size,
            purge_months=None if options.no_cleanup else options.months,
            newest_page=options.newest_page or None,
            parse_rfc822=options.parse_rfc822,
            sources=configured,
        )
        rejected = [
            feed_rejects(feeds).select(F.col("feed_url").alias("source"), "payload_id", "reason"),
            unconfigured_feeds(filed, configured).withColumnRenamed("name", "source"),
            unreadable_responses(api).withColumnRenamed("category", "source"),
            listing_rejects(listings).select(
                F.lit(settings.LISTING_SOURCE).alias("source"), F.col("page_id").alias("payload_id"), "reason"
            ),
        ]
        return {**shown, "rejects": union_sources(rejected)}
    if options.compact:
        return {"compacted": article_count(store.compact(options.compact).log())}
    if options.stats:
        return store_statistics(store, options.as_of)
    shown = {}
    if options.dry_run:
        cutoff = retention_cutoff(options.as_of, options.months)
        shown["sample"] = purge_sample(store.current(), cutoff)
    return {"purge": store.purge(options.as_of, options.months, options.dry_run), **shown}


def main() -> None:
    options = arguments()
    spark = SparkSession.builder.appName(f"newsweave {options.job}").getOrCreate()
    for name, frame in run(spark, options).items():
        print(f"== {name}")
        if "number" in frame.columns:
            frame.orderBy("number").show(options.size, truncate=False)
        else:
            frame.show(settings.DIGEST_SIZE, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
