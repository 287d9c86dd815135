"""Configuration as dimension tables: collected sources and API categories.

Both are fixed lists of a few dozen rows, so broadcasting them is safe.
"""

from pyspark.sql import DataFrame, SparkSession

from newsweave import settings

SOURCE_DIM = "name string, url string, kind string, cap int, source_rank int"
CATEGORY_DIM = "category string, max_limit int, priority int"


def source_rows() -> list[tuple]:
    """(name, url, kind, cap, source_rank) of every feed and the listing page."""
    news = [
        (name, url, "news_feed", settings.NEWS_FEED_CAP)
        for name, url in settings.NEWS_FEEDS.items()
    ]
    publications = [
        (f"medium_pub_{number}", url, "publication_feed", settings.PUBLICATION_FEED_CAP)
        for number, url in enumerate(settings.PUBLICATION_FEEDS, 1)
    ]
    listing = [("medium_trending_page", settings.LISTING_URL, "listing", settings.LISTING_CAP)]
    return [
        (*row, rank) for rank, row in enumerate(news + publications + listing)
    ]


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(source_rows(), SOURCE_DIM)


def category_dim(spark: SparkSession) -> DataFrame:
    rows = [(name, cap, rank) for name, (cap, rank) in settings.API_CATEGORIES.items()]
    return spark.createDataFrame(rows, CATEGORY_DIM)
