"""API responses (JSON text) to articles and trending topics."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.dates import normalize_published
from newsweave.functions.text import or_blank, present
from newsweave.schema import ARRIVAL_FIELDS, ARTICLE_FIELDS, conform

NEWS_SCHEMA = (
    "data struct<news_list: array<struct<hash_id: string, title: string, content: string, "
    "source_name: string, source_url: string, image_url: string, created_at: variant, "
    "tags: array<string>>>>"
)
TOPICS_SCHEMA = (
    "data struct<topics: array<struct<name: string>>>, trending_topics array<string>"
)


def with_category_cap(
    payloads: DataFrame, categories: DataFrame, override: int | None = None
) -> DataFrame:
    """Add ``cap`` and ``source_rank`` from the category dimension.

    The cap is the override, else the configured limit, else the limit for
    unknown categories, which also rank after all configured ones.
    """
    known = F.broadcast(categories.select("category", "max_limit", "priority"))
    last = F.lit(len(settings.API_CATEGORIES) + 1)
    return payloads.join(known, "category", "left").select(
        *payloads.columns,
        F.coalesce(
            F.lit(override).cast("int"), "max_limit", F.lit(settings.UNKNOWN_CATEGORY_CAP)
        ).alias("cap"),
        F.coalesce("priority", last).alias("source_rank"),
    )


def api_items(payloads: DataFrame) -> DataFrame:
    """One row per returned item, at most ``cap`` per response, in order.

    A response that is not JSON, or lacks the list, yields no rows.
    """
    listed = F.from_json(F.col("payload"), NEWS_SCHEMA)["data"]["news_list"]
    return payloads.select(
        "category",
        "source_rank",
        "payload_id",
        F.posexplode(F.slice(listed, 1, F.col("cap"))).alias("position", "item"),
    )


def _usable(item: Column) -> Column:
    return present(item["title"]) & present(item["source_url"])


def _created(item: Column, run_ts: datetime) -> Column:
    """Publication text; a value that is not text counts as unreadable."""
    value = item["created_at"]
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    unreadable = value.isNotNull() & ~kind.isin("STRING", "VOID")
    return F.when(unreadable, F.lit(run_ts.isoformat())).otherwise(normalize_published(text, run_ts))


def item_articles(items: DataFrame, run_ts: datetime) -> DataFrame:
    """Map items to articles; an item without title or address is left out."""
    item = F.col("item")
    articles = items.where(_usable(item)).select(
        item["title"].alias("title"),
        item["source_url"].alias("url"),
        _created(item, run_ts).alias("published"),
        or_blank(item["content"]).alias("summary"),
        F.lit(settings.API_SOURCE).alias("source"),
        F.concat(
            F.coalesce(item["tags"], F.array().cast("array<string>")), F.array("category")
        ).alias("tags"),
        or_blank(item["image_url"]).alias("image"),
        or_blank(item["hash_id"]).alias("inshorts_id"),
        or_blank(item["source_name"]).alias("original_source"),
        "source_rank",
        "payload_id",
        "position",
    )
    return conform(articles, {**ARTICLE_FIELDS, **ARRIVAL_FIELDS})


def api_articles(
    payloads: DataFrame, categories: DataFrame, run_ts: datetime, override: int | None = None
) -> DataFrame:
    """Articles of landed responses ``category, payload_id, payload``."""
    return item_articles(api_items(with_category_cap(payloads, categories, override)), run_ts)


def api_rejects(items: DataFrame) -> DataFrame:
    """Rejected items per category."""
    return items.where(~_usable(F.col("item"))).groupBy("category").agg(
        F.count("*").alias("rejected")
    )


def unreadable_responses(payloads: DataFrame) -> DataFrame:
    """Responses that are not JSON or lack the list: category, payload_id and reason."""
    listed = F.from_json(F.col("payload"), NEWS_SCHEMA)["data"]["news_list"]
    return payloads.where(listed.isNull()).select(
        "category", "payload_id", F.lit("unreadable").alias("reason")
    )


def trending_topics(payloads: DataFrame) -> DataFrame:
    """One row per topic of each response ``payload_id, payload``, in order.

    A response holds either named topic objects or plain strings; a topic
    without a name is ''.
    """
    body = F.from_json(F.col("payload"), TOPICS_SCHEMA)
    named = F.transform(body["data"]["topics"], lambda topic: or_blank(topic["name"]))
    return payloads.select(
        "payload_id",
        F.posexplode(F.coalesce(named, body["trending_topics"])).alias("position", "topic"),
    )


def topic_counts(topics: DataFrame) -> DataFrame:
    return topics.groupBy("topic").agg(F.count("*").alias("mentions"))
