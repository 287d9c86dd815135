"""Counts, coverage and run metrics.

Each report is one scan with map-side partial aggregation.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.text import present
from newsweave.operators.images import has_image
from newsweave.operators.retention import scraped_before, scraped_since


def _weighed(weight: Column | None, which: Column | None = None) -> Column:
    """How many articles the rows that are meant stand for: one each, or their weight."""
    if weight is None:
        return F.count("*") if which is None else F.count_if(which)
    return F.coalesce(F.sum(weight if which is None else F.when(which, weight)), F.lit(0))


def article_count(articles: DataFrame, weight: Column | None = None) -> DataFrame:
    return articles.agg(_weighed(weight).alias("total_articles"))


def age_buckets(
    articles: DataFrame,
    as_of: datetime,
    week_days: int = 7,
    month_days: int = 30,
    old_days: int = settings.STATS_OLD_DAYS,
    weight: Column | None = None,
) -> DataFrame:
    """All, last week, last month and old articles: overlapping counts, one scan.

    ``weight`` says how many articles a row stands for.
    """

    def days_ago(days: int) -> datetime:
        return as_of - timedelta(days=days)

    return articles.agg(
        _weighed(weight).alias("total_articles"),
        _weighed(weight, scraped_since(days_ago(week_days))).alias("last_week"),
        _weighed(weight, scraped_since(days_ago(month_days))).alias("last_month"),
        _weighed(weight, scraped_before(days_ago(old_days))).alias("older"),
    )


def top_sources(
    articles: DataFrame, size: int = settings.TOP_SOURCES, weight: Column | None = None
) -> DataFrame:
    """Sources with most articles; articles without one form their own group."""
    return (
        articles.groupBy("source")
        .agg(_weighed(weight).alias("count"))
        .orderBy(F.desc("count"), "source")
        .limit(size)
    )


def _percent(part: Column, whole: Column) -> Column:
    share = 100.0 * part.cast("double") / whole.cast("double")
    return F.when(whole > 0, F.round(share, 1)).otherwise(F.lit(0.0))


def image_coverage(articles: DataFrame) -> DataFrame:
    """Share of articles with an image, per source and overall, from one scan."""
    with_image = F.count_if(has_image(F.col("image")))
    return (
        articles.select("source", "image")
        .rollup("source")
        .agg(
            (F.grouping("source") == 1).alias("overall"),
            with_image.alias("with_image"),
            F.count("*").alias("total"),
            _percent(with_image, F.count("*")).alias("percent"),
        )
    )


def coverage_gain(
    enriched: DataFrame, goal: float = settings.COVERAGE_GOAL_PERCENT
) -> DataFrame:
    """Coverage before and after enrichment, from its ``had_image`` mark."""
    before = _percent(F.count_if("had_image"), F.count("*"))
    after = _percent(F.count_if(has_image(F.col("image"))), F.count("*"))
    return enriched.agg(
        F.count("*").alias("total"), before.alias("before_percent"), after.alias("after_percent")
    ).select(
        "total",
        "before_percent",
        "after_percent",
        F.round(F.col("after_percent") - F.col("before_percent"), 1).alias("gain_points"),
        (F.col("after_percent") >= goal).alias("goal_met"),
    )


def dedup_metrics(articles: DataFrame) -> DataFrame:
    """Rows in, rows with no address, distinct addresses and rows removed.

    Grouping by address first keeps the distinct count to two plain hash
    aggregates.
    """
    per_url = articles.groupBy("url").agg(F.count("*").alias("n"))
    filled = present(F.col("url"))
    return per_url.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("blank_urls"),
        F.count_if(filled).alias("rows_out"),
    ).withColumn("removed", F.col("rows_in") - F.col("rows_out"))


def empty_sources(sources: DataFrame, articles: DataFrame, key: str = "source") -> DataFrame:
    """Configured sources that delivered no article."""
    return sources.join(articles.select(key).distinct(), key, "left_anti")


def category_capacity(categories: DataFrame) -> DataFrame:
    return categories.agg(
        F.count("*").alias("categories"), F.sum("max_limit").alias("max_articles")
    )


def categories_by_priority(categories: DataFrame, size: int = 5) -> DataFrame:
    return categories.orderBy("priority").limit(size)


def daily_arrivals(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.to_date("scraped_at").alias("day"), "source").agg(
        F.count("*").alias("articles")
    )
