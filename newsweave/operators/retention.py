"""Recent and expired articles."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.dates import utc_literal


def retention_cutoff(as_of: datetime, months: int = settings.RETENTION_MONTHS) -> datetime:
    """A month counts as thirty days."""
    return as_of - timedelta(days=months * settings.DAYS_PER_MONTH)


def scraped_since(cutoff: datetime) -> Column:
    return F.col("scraped_at") >= utc_literal(cutoff)


def scraped_before(cutoff: datetime) -> Column:
    return F.col("scraped_at") < utc_literal(cutoff)


def purge_keep(articles: DataFrame, cutoff: datetime) -> DataFrame:
    """What a purge leaves in place."""
    return articles.where(~F.coalesce(scraped_before(cutoff), F.lit(False)))


def recent_articles(
    articles: DataFrame,
    as_of: datetime,
    days: int = settings.RECENT_DAYS,
    limit: int = settings.RECENT_LIMIT,
) -> DataFrame:
    """Newest scraped first, ties by address."""
    since = as_of - timedelta(days=days)
    return (
        articles.where(scraped_since(since)).orderBy(F.desc("scraped_at"), "url").limit(limit)
    )


def purge_sample(
    articles: DataFrame, cutoff: datetime, size: int = settings.PURGE_SAMPLE, ties: tuple = ("url",)
) -> DataFrame:
    """The oldest expired rows, as a dry run shows them."""
    return (
        articles.where(scraped_before(cutoff))
        .orderBy("scraped_at", *ties)
        .limit(size)
        .select("title", "source", "scraped_at")
    )


def failed_purge(spark: SparkSession, cutoff: datetime) -> DataFrame:
    """The report of a purge that could not be done."""
    kinds = "success boolean, dry_run boolean, deleted_count bigint, would_delete_count bigint, total_remaining bigint, cutoff_date string"
    return spark.createDataFrame([(False, False, 0, None, None, cutoff.isoformat())], kinds)


def purge_report(
    articles: DataFrame, cutoff: datetime, dry_run: bool = False, weight: Column | None = None
) -> DataFrame:
    """Outcome of a purge as one row; nothing matched gives the same shape.

    ``weight`` says how many articles a row stands for.
    """
    each = F.lit(1).cast("bigint") if weight is None else weight
    expired = F.coalesce(F.sum(F.when(scraped_before(cutoff), each)), F.lit(0))
    total = F.coalesce(F.sum(each), F.lit(0))
    nothing = F.lit(None).cast("bigint")
    return articles.agg(
        F.lit(True).alias("success"),
        F.lit(dry_run).alias("dry_run"),
        (nothing if dry_run else expired).alias("deleted_count"),
        (expired if dry_run else nothing).alias("would_delete_count"),
        (total if dry_run else total - expired).alias("total_remaining"),
        F.lit(cutoff.isoformat()).alias("cutoff_date"),
    )
