"""The article store: Parquet partitioned by scrape date and batch.

Parquet has no row updates, so a batch is appended and the row saved last per
address is the current one. A batch rewrites only its own partitions and keeps its number
among the saves, so running it again changes nothing. What is known of an address is looked
up in an index beside the rows, in the partitions the batch's addresses fall into, so
a save reads and writes in proportion to the batch, not to the store. Statistics come
from what the saves changed. Index and changes are made again from the rows if a save or purge
did not end. Compaction writes the current rows to a new folder.
"""

import re
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.dates import utc_literal
from newsweave.operators.ranking import keep_first, keep_last
from newsweave.operators.retention import (
    purge_keep,
    purge_report,
    recent_articles,
    retention_cutoff,
    scraped_before,
    scraped_since,
)
from newsweave.operators.upsert import carry_ids, prepare, upsert_outcome
from newsweave.schema import ARTICLE_FIELDS, STORE_FIELDS, conform, ddl
from newsweave.session import broadcast_if_small, materialize, remove_folder, write_out
from newsweave.sources.addresses import ENTRY_FIELDS, AddressIndex

PARTITIONS = ["scraped_date", "batch"]
# What an entry of the index holds of a row.
ENTRY = [name for name in ENTRY_FIELDS if name != "url_bucket"]
PURGE = "_purge"
BATCH_NAME = re.compile(r"[A-Za-z0-9._-]+")


def _newest() -> list[Column]:
    return [F.desc_nulls_last("saved"), F.desc("scraped_at"), F.desc("batch")]


def newest_times(entries: DataFrame) -> DataFrame:
    last = F.max(F.struct("saved", "scraped_at"))["scraped_at"]
    return entries.groupBy("url").agg(last.alias("scraped_at"))


class ArticleStore:
    """Current articles by address, kept in a folder of Parquet partitions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = settings.STORE_BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.index = AddressIndex(spark, f"{self.path}/_state", buckets)

    def log(self) -> DataFrame:
        """Every stored row, superseded ones included."""
        try:
            return self.spark.read.schema(ddl(STORE_FIELDS)).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], ddl(STORE_FIELDS))

    def current(self) -> DataFrame:
        """One row per address: the last saved."""
        return keep_first(self.log(), _newest())

    def entries(self) -> DataFrame:
        """Address, id, source, time, number and batch of every stored row."""
        self._ready()
        return self.index.entries()

    def newest_times(self) -> DataFrame:
        """Address and current scrape time, without any text."""
        return newest_times(self.entries())

    def counts(self) -> DataFrame:
        """Current articles by time and source, from the saves' changes: scraped_at, source, articles."""
        self._ready()
        return self.index.counts()

    def _ready(self, work: str | None = None) -> None:
        """See that index and changes stand for all rows: made again if other work did not end."""
        if not self.index.is_there() or set(self.index.unfinished()) - {work}:
            self.rebuild()

    def rebuild(self) -> None:
        """Make the index, the numbers of the saves and the changes again from the rows."""
        rows = self.log().select(*ENTRY)
        self.index.renew_entries(rows)
        numbers = self.index.entries().groupBy("batch").agg(F.max("saved").alias("saved"))
        known = self.index.numbers()
        # One row per batch, a few at a time.
        for row in numbers.where("saved is not null").toLocalIterator():
            if row.batch not in known:
                self.index.number(row.batch, row.saved)
        self.index.renew_changes(keep_first(self.index.entries(), _newest()))
        for work in self.index.unfinished():
            self.index.end(work)

    def save(
        self,
        articles: DataFrame,
        batch: str,
        order: list,
        run_ts: datetime | None = None,
        newer_only: bool = False,
    ) -> DataFrame:
        """Insert or replace articles by address; returns the outcome as one row.

        A known address keeps its id. The batch is computed once, into a working
        table; of the index only the partitions of its addresses are read, without this batch's
        own earlier attempt. With ``newer_only`` rows older than what the store holds of
        their address are not written: for batches that arrive in no order of time.
        """
        if not BATCH_NAME.fullmatch(batch):
            raise ValueError(f"not usable as a folder name: {batch!r}")
        fields = {**ARTICLE_FIELDS, "scraped_at": STORE_FIELDS["scraped_at"]}
        extra = tuple(name for name in order if name not in fields)
        staged, folder = write_out(conform(articles, fields, extra), "batch")
        self._ready(batch)
        numbers = self.index.numbers()
        again = batch in numbers
        place = numbers[batch] if again else max(numbers.values(), default=0) + 1
        self.index.begin(batch)
        self.index.number(batch, place)
        number = F.lit(place).cast("bigint")
        ready = prepare(staged, run_ts).withColumns({"batch": F.lit(batch), "saved": number})
        incoming = conform(ready, STORE_FIELDS, extra)
        latest = keep_last(incoming, order)
        other = F.col("batch") != batch
        if newer_only:  # a replay meets what its first attempt met
            other &= F.col("saved") < number
        others = self.index.near(staged.select("url")).where(other)
        known = materialize(
            keep_first(others, _newest()).select(
                "url", F.col("article_id").alias("known_id"), F.col("scraped_at").alias("_known_at"),
                F.col("source").alias("_known_source"),
            )
        )
        ready = carry_ids(latest, known)
        if newer_only:
            ready = ready.where(F.col("_known_at").isNull() | (F.col("scraped_at") >= F.col("_known_at")))
        self._replace_partitions(ready)
        outcome = materialize(upsert_outcome(known, staged))
        self._enter(batch, known, again)
        remove_folder(self.spark, folder)
        return outcome

    def _enter(self, batch: str, known: DataFrame, again: bool) -> None:
        """Enter a batch just written into the index; a batch saved before is counted anew."""
        written = self.log().where(F.col("batch") == batch).select(*ENTRY)
        self.index.add(written)
        if again:
            self.index.renew_changes(keep_first(self.index.entries(), _newest()))
        else:
            replaced = known.join(written.select("url"), "url", "left_semi").select(
                F.col("_known_at").alias("scraped_at"), F.col("_known_source").alias("source")
            )
            self.index.add_changes(written, replaced, batch)
        self.index.end(batch)

    def recent(
        self,
        as_of: datetime,
        days: int = settings.RECENT_DAYS,
        limit: int = settings.RECENT_LIMIT,
    ) -> DataFrame:
        """Newest scraped articles. Reads only partitions inside the window.

        A later save may have given an address an older time, outside the window; of
        the other days only addresses saved after the first row of the window are read.
        """
        since = as_of - timedelta(days=days)
        inside = (F.col("scraped_date") >= F.lit(since.date())) & scraped_since(since)
        seen = keep_first(self.log().where(inside), _newest())
        entries = self.entries()
        first = entries.where(scraped_since(since)).agg(F.min("saved")).first()[0]
        if first is None:
            return recent_articles(seen, as_of, days, limit)
        later = entries.where((F.col("saved") > first) & ~scraped_since(since))
        moved = later.groupBy("url").agg(F.max("saved").alias("_moved"))
        still = F.col("_moved").isNull() | (F.col("_moved") < F.col("saved"))
        current = seen.join(moved, "url", "left").where(still).drop("_moved")
        return recent_articles(current, as_of, days, limit)

    def purge(
        self,
        as_of: datetime,
        months: int = settings.RETENTION_MONTHS,
        dry_run: bool = False,
        cutoff: datetime | None = None,
    ) -> DataFrame:
        """Remove articles scraped before the cutoff; returns the report.

        Whole days before the cutoff are dropped as folders; only the day of the
        cutoff is rewritten, and batches that hold older saves of an expired address
        under a later time. Partitions are overwritten with what stays of them before
        anything is removed, so no article that stays is missing at any point.
        """
        cutoff = cutoff or retention_cutoff(as_of, months)
        report = materialize(purge_report(self.counts(), cutoff, dry_run, F.col("articles")))
        if dry_run:
            return report
        self.index.begin(PURGE)
        day = F.lit(cutoff.date())
        times = newest_times(self.index.entries())
        expired = broadcast_if_small(materialize(times.where(scraped_before(cutoff)).select("url")))
        # Entries after the cutoff whose address expired would come to light again without its last save.
        after = self.entries_of(scraped_since(cutoff)).join(expired, "url", "left_semi")
        boundary = self.log().where(F.col("scraped_date") == day).select(*PARTITIONS)
        touched = materialize(after.select(*PARTITIONS).unionByName(boundary).distinct())
        rows = self.log().join(broadcast_if_small(touched), PARTITIONS, "left_semi")
        kept, folder = write_out(purge_keep(rows, cutoff).join(expired, "url", "left_anti"), "kept")
        self._replace_partitions(kept)
        # Folder names only: at most one per day, and one per batch left without a row, a few at a time.
        emptied = touched.join(broadcast_if_small(kept.select(*PARTITIONS).distinct()), PARTITIONS, "left_anti")
        for row in emptied.toLocalIterator():
            remove_folder(self.spark, f"{self.path}/scraped_date={row.scraped_date}/batch={row.batch}")
        for row in self.log().where(F.col("scraped_date") < day).select("scraped_date").distinct().collect():
            remove_folder(self.spark, f"{self.path}/scraped_date={row.scraped_date}")
        remove_folder(self.spark, folder)
        self.rebuild()
        return report

    def entries_of(self, which: Column) -> DataFrame:
        """Entries of the rows that are meant, with the partition they stand in."""
        return self.index.entries().where(which).withColumn("scraped_date", F.to_date("scraped_at"))

    def compact(self, target: str) -> "ArticleStore":
        """Write the current rows to a new folder and return the store there."""
        rows = self.current().hint("rebalance", *PARTITIONS)
        rows.write.mode("errorifexists").partitionBy(*PARTITIONS).parquet(target)
        return ArticleStore(self.spark, target)

    def _replace_partitions(self, rows: DataFrame) -> None:
        """Overwrite the partitions the rows fall into, and no others.

        Rebalancing by partition gives each day few files of even size: small
        days are put together, a day holding most rows is split.
        """
        (
            rows.select(*STORE_FIELDS)
            .hint("rebalance", *PARTITIONS)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS)
            .parquet(self.path)
        )
