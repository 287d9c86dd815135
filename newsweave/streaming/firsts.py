"""First arrivals and daily counts kept up to date over a stream, with nothing lost on the way.

A micro-batch is first shrunk to what its tables need and then merged into the few partitions it
touches. Every micro-batch writes partitions of its own name, or the same result again, so a
replayed one changes nothing.
"""

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsweave import settings
from newsweave.functions.dates import as_instant, utc_literal
from newsweave.functions.text import present
from newsweave.operators.ranking import keep_first
from newsweave.schema import ddl
from newsweave.session import make_folder, names_in, remove_folder, write_out


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, empty before anything was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.hint("rebalance", *by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(path)


def _run(stream: DataFrame, save, checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(save)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


# First arrivals


def first_in_windows(articles: DataFrame, delay: str, arrival: list, time: str = "scraped_at") -> DataFrame:
    """The first arrival of each address so far in its window of event time: url and first.

    A stateful minimum: ``first`` is the whole row with the least arrival. Copies are reduced in every
    task before the shuffle, so an address on most of the stream meets as a few rows. A window's
    state goes once the watermark has passed it.
    """
    row = F.struct(*[F.col(name) for name in articles.columns])
    return (
        articles.where(present(F.col("url")))
        .withColumn("_at", as_instant(F.col(time)))
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", delay), "url")
        .agg(F.min_by(row, F.struct(*arrival)).alias("first"))
        .select("url", "first")
    )


def firsts_available(
    articles: DataFrame,
    path: str,
    checkpoint: str,
    delay: str,
    arrival: list,
    time: str = "scraped_at",
    buckets: int = settings.STORE_BUCKETS,
) -> StreamingQuery:
    """Keep a table of the first arrival per address, whatever the order in which files land.

    What a micro-batch finds is merged with the table's own rows in the partitions of its
    addresses: the lesser arrival stays, over all windows. So the table is that of the batch
    operator over all rows that came no later than ``delay`` behind the stream.
    """
    columns = articles.columns

    def save(batch: DataFrame, number: int) -> None:
        place = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("url_bucket")
        changed, folder = write_out(batch.select("first.*").select(*columns, place), "changed")
        touched = F.broadcast(changed.select("url_bucket").distinct())  # a row per bucket at most
        kept = read_table(batch.sparkSession, path, changed.schema).join(touched, "url_bucket", "left_semi")
        # Both are read before the partitions are replaced.
        merged, other = write_out(keep_first(kept.select(*changed.columns).unionByName(changed), arrival), "merged")
        _overwrite(merged, path, ["url_bucket"])
        for each in (folder, other):
            remove_folder(batch.sparkSession, each)

    return _run(first_in_windows(articles, delay, arrival, time), save, checkpoint, "update")


# Daily counts, and rows behind the watermark

COUNT_FIELDS = {"day": "date", "source": "string", "articles": "bigint", "batch": "bigint"}


class DailyCounts:
    """Articles per source and day of a stream, and the rows that came too late to count.

    A row is late if its time is more than ``delay`` behind the newest of the micro-batches
    before its own. Late rows go to a table of their own, so the rows that came in are those counted
    and those set aside.
    """

    def __init__(self, spark: SparkSession, path: str, delay: timedelta, time: str = "scraped_at"):
        self.spark, self.path, self.delay, self.time = spark, path.rstrip("/"), delay, time

    def update(self, articles: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in everything landed so far."""
        return _run(articles, self._save, checkpoint)

    def _newest_before(self, number: int) -> datetime | None:
        """The newest time of the micro-batches before, from the names of their marks."""
        marks = (name.split("-", 1) for name in names_in(self.spark, f"{self.path}/seen"))
        times = [int(micros) for batch, micros in marks if int(batch) < number]
        return datetime(1970, 1, 1) + timedelta(microseconds=max(times)) if times else None

    def _save(self, batch: DataFrame, number: int) -> None:
        newest = self._newest_before(number)
        time = F.col(self.time)
        late: Column = F.lit(False)
        if newest is not None:
            late = F.coalesce(time < utc_literal(newest - self.delay), F.lit(False))
        named = batch.withColumns({"late": late, "batch": F.lit(number).cast("bigint")})
        rows, folder = write_out(named, "arrived")
        counted = rows.where("not late").groupBy(F.to_date(time).alias("day"), "source", "batch").agg(F.count("*").alias("articles"))
        _overwrite(counted.select(*COUNT_FIELDS), f"{self.path}/counts", ["batch"])
        _overwrite(rows.where("late").drop("late"), f"{self.path}/late", ["batch"])
        micros = F.unix_micros(as_instant(time))
        (last,) = rows.agg(F.max(micros)).first()
        if last is not None:
            make_folder(self.spark, f"{self.path}/seen/{number:012d}-{last}")
        remove_folder(self.spark, folder)

    def counts(self) -> DataFrame:
        """day, source, articles."""
        parts = read_table(self.spark, f"{self.path}/counts", ddl(COUNT_FIELDS))
        return parts.groupBy("day", "source").agg(F.sum("articles").alias("articles"))

    def late(self, like: DataFrame) -> DataFrame:
        """The rows set aside, with the micro-batch that brought them; ``like`` has their columns."""
        return read_table(self.spark, f"{self.path}/late", like.withColumn("batch", F.lit(0).cast("bigint")).schema)
