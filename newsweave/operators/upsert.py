"""Merging a batch of articles into stored ones by address."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.functions.dates import compact_date, iso_text, utc_literal
from newsweave.functions.text import or_blank, present
from newsweave.operators.ranking import keep_last


def prepare(articles: DataFrame, run_ts: datetime | None = None) -> DataFrame:
    """Rows ready to store: blank addresses rejected, run metadata added.

    With no ``run_ts`` the rows' own ``scraped_at`` is used.
    """
    stamped = articles.where(present(F.col("url")))
    if run_ts is not None:
        stamped = stamped.withColumn("scraped_at", utc_literal(run_ts))
    scraped = F.col("scraped_at")
    return stamped.withColumns(
        {
            "article_id": F.concat_ws(
                "_", F.substring(F.md5(F.col("url").cast("binary")), 1, 16),
                compact_date(scraped),
            ),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "published": F.when(or_blank(F.col("published")) == "", iso_text(scraped)).otherwise(
                F.col("published")
            ),
            "scraped_date": F.to_date(scraped),
        }
    )


def known_ids(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``url, known_id`` of the incoming addresses that are already stored.

    Reads two narrow columns of the store. A small batch is broadcast to it by
    its measured size; a large one meets it on the address.
    """
    return stored.select("url", F.col("article_id").alias("known_id")).join(
        incoming.select("url"), "url", "left_semi"
    )


def carry_ids(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming rows, each keeping the id its address is stored under."""
    return (
        incoming.join(known, "url", "left")
        .withColumn("article_id", F.coalesce("known_id", "article_id"))
        .drop("known_id")
    )


def upsert(stored: DataFrame, incoming: DataFrame, order: list) -> DataFrame:
    """The stored table after merging: whole rows replaced by address.

    Within the batch the last row per address wins. ``stored`` holds each
    address once. Written as an anti join plus a left join rather than a full
    outer join, so that a small batch never makes Spark shuffle the store.
    """
    arriving = incoming.where(present(F.col("url"))).select("url").distinct()
    replaced = carry_ids(keep_last(incoming, order), known_ids(stored, arriving))
    untouched = stored.join(arriving, "url", "left_anti")
    return untouched.select(*stored.columns).unionByName(replaced.select(*stored.columns))


def upsert_outcome(stored_urls: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts of inserted, updated and rejected rows of a batch, in one row.

    Every row of the batch is tried: the first for a new address inserts, any
    other updates. Rows are counted per address before the join.
    """
    per_url = batch.groupBy("url").agg(F.count("*").alias("n"))
    filled = present(F.col("url"))
    known = stored_urls.select("url", F.lit(True).alias("stored"))
    return (
        per_url.join(known, "url", "left")
        .agg(
            F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("saved"),
            F.count_if(filled & F.col("stored").isNull()).alias("inserted"),
            F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("rejected"),
        )
        .select(
            "inserted",
            (F.col("saved") - F.col("inserted")).alias("updated"),
            "rejected",
            (F.col("saved") > 0).alias("success"),
        )
    )
