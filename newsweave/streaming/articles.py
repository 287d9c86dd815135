"""The same operators over landed files as they arrive."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newsweave.functions.dates import as_instant
from newsweave.functions.text import present
from newsweave.session import remove_folder, write_out
from newsweave.sources.feeds import feed_articles
from newsweave.sources.store import ArticleStore


def landed(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """New Parquet files of a landing folder, a bounded number at a time."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_feed_articles(payloads: DataFrame) -> DataFrame:
    """Articles of feed documents as they land: a map, no state."""
    return feed_articles(payloads)


def stream_unique(
    articles: DataFrame, delay: str, spread_by: list, salts: int = 32, time: str = "scraped_at"
) -> DataFrame:
    """Articles whose address was not seen within ``delay``.

    Copies are first dropped per address and salt, then per address: an address on a
    large share of the stream is thinned by many tasks before it meets in one.
    ``spread_by`` names columns that differ between copies, such as their arrival.
    Which copy passes is the engine's choice; it passes whole. State is bounded by the
    delay; an address that returns later passes again, and the store's upsert settles it.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    return (
        articles.where(present(F.col("url")))
        .withColumns({"arrived": as_instant(F.col(time)), "_salt": salt})
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["url", "_salt"])
        .dropDuplicatesWithinWatermark(["url"])
        .drop("_salt")
    )


def stream_daily_arrivals(articles: DataFrame, delay: str) -> DataFrame:
    """Articles per source and day; a day's state is dropped once the delay has passed."""
    return (
        articles.withColumn("arrived", as_instant(F.col("scraped_at")))
        .withWatermark("arrived", delay)
        .groupBy(F.window("arrived", "1 day").alias("day"), "source")
        .agg(F.count("*").alias("articles"))
    )


def write_available(
    articles: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process everything landed so far into a Parquet folder, exactly once."""
    query = (
        articles.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def daily_arrivals_available(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of daily counts, partitioned by day, up to date with all landed so far.

    A micro-batch brings the counts that changed; only the days it touches are
    rewritten, and a replayed one changes nothing.
    """

    def save(batch: DataFrame, number: int) -> None:
        start = F.unix_seconds("day.start") / 86400
        changed = batch.select(
            F.date_from_unix_date(start.cast("int")).alias("day"), "source", "articles"
        )
        changed, folder = write_out(changed, "changed")
        days = F.broadcast(changed.select("day").distinct())
        kept = read_daily_arrivals(batch.sparkSession, path).join(days, "day", "left_semi").join(
            changed.withColumnRenamed("source", "_source").drop("articles").withColumnRenamed("day", "_day"),
            (F.col("day") == F.col("_day")) & F.col("source").eqNullSafe(F.col("_source")),
            "left_anti",
        )
        merged, other = write_out(kept.unionByName(changed), "merged")
        merged.hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day").parquet(path)
        for each in (folder, other):
            remove_folder(batch.sparkSession, each)

    query = (
        counts.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_daily_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """The table of daily counts, empty before anything landed."""
    schema = "source string, articles bigint, day date"
    try:
        return spark.read.schema(schema).parquet(path).select("day", "source", "articles")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema).select("day", "source", "articles")


def upsert_available(
    articles: DataFrame, store: ArticleStore, order: list, checkpoint: str, name: str = "stream"
) -> StreamingQuery:
    """Upsert everything landed so far, micro-batch by micro-batch.

    Files arrive in no order of time, so a row older than the stored one changes nothing.
    A replayed micro-batch replaces its own partitions, so it counts once.
    """

    def save(batch: DataFrame, number: int) -> None:
        store.save(batch, f"{name}-{number:012d}", order, newer_only=True)

    query = (
        articles.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
