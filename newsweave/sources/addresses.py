"""What a store knows of its addresses, so that a save need not read the store.

Beside the rows stand, in a folder that readers of the rows pass over:

* ``addresses``: one short entry per stored row, in partitions by a hash of the address. A save
  looks its addresses up in the partitions they fall into, and reads no others.
* ``changes``: how many current articles a save added and took away, by time and source. Their
  sums are the store's statistics, without a scan of it.
* ``saves``: the number each batch got among the saves. ``open``: work begun and not ended.

All of it can be made again from the rows, and is when some work did not end or a
batch is saved once more out of turn. A new version stands beside the old one until it is
whole.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.schema import conform, ddl
from newsweave.session import BROADCAST_BYTES, ROW_BYTES, make_folder, names_in, remove_folder

ENTRY_FIELDS = {
    "url": "string",
    "article_id": "string",
    "source": "string",
    "scraped_at": "timestamp_ntz",
    "saved": "bigint",
    "url_bucket": "int",
    "batch": "string",
}
CHANGE_FIELDS = {"scraped_at": "timestamp_ntz", "source": "string", "articles": "bigint", "batch": "string"}
# The batch of changes that were counted anew.
COUNTED = "_counted"


class AddressIndex:
    """The folder of a store's addresses, changes and saves."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = settings.STORE_BUCKETS):
        self.spark = spark
        self.folder = folder
        self.buckets = buckets

    def _version(self, kind: str) -> tuple[int, int] | None:
        """Number and buckets of the newest whole version."""
        found = [tuple(map(int, name.split(".")[1:])) for name in names_in(self.spark, self.folder) if name.startswith(f"{kind}.")]
        for version in sorted(found, reverse=True):
            if "_SUCCESS" in names_in(self.spark, self._path(kind, version)):
                return version
        return None

    def _path(self, kind: str, version: tuple[int, int]) -> str:
        return f"{self.folder}/{kind}.{version[0]}.{version[1]}"

    def _write(self, rows: DataFrame, path: str, partitions: list[str], replace: str) -> None:
        """Write partitions; ``replace`` is those the rows fall into (dynamic) or all (static)."""
        rows.hint("rebalance", *partitions).write.mode("overwrite").option(
            "partitionOverwriteMode", replace
        ).partitionBy(*partitions).parquet(path)

    def _renew(self, kind: str, rows: DataFrame, partitions: list[str]) -> None:
        """Write a new version; versions before the last one go."""
        last = self._version(kind) or (0, self.buckets)
        next_ = (last[0] + 1, self.buckets)
        self._write(rows, self._path(kind, next_), partitions, "static")
        for name in names_in(self.spark, self.folder):
            if name.startswith(f"{kind}.") and int(name.split(".")[1]) <= last[0]:
                remove_folder(self.spark, f"{self.folder}/{name}")

    def bucket(self, url: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")

    # Entries

    def is_there(self) -> bool:
        return self._version("addresses") is not None and self._version("changes") is not None

    def entries(self) -> DataFrame:
        path = self._path("addresses", self._version("addresses"))
        return self.spark.read.schema(ddl(ENTRY_FIELDS)).parquet(path)

    def near(self, urls: DataFrame) -> DataFrame:
        """The entries of the addresses of a stored table, from the partitions they fall into."""
        buckets = self._version("addresses")[1]
        url = F.col("url")
        width = F.coalesce(F.octet_length(url), F.lit(0)) + ROW_BYTES
        # One row, with no more values than there are buckets.
        met, size = urls.agg(F.collect_set(self.bucket(url, buckets)), F.coalesce(F.sum(width), F.lit(0))).first()
        wanted = urls.select("url").distinct()
        return self.entries().where(F.col("url_bucket").isin(met)).join(
            F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "url", "left_semi"
        )

    def add(self, rows: DataFrame) -> None:
        """Enter a batch's rows, in the place of its earlier ones."""
        version = self._version("addresses")
        entered = rows.withColumn("url_bucket", self.bucket(F.col("url"), version[1]))
        self._write(conform(entered, ENTRY_FIELDS), self._path("addresses", version), ["url_bucket", "batch"], "dynamic")

    def renew_entries(self, rows: DataFrame) -> None:
        entered = rows.withColumn("url_bucket", self.bucket(F.col("url"), self.buckets))
        self._renew("addresses", conform(entered, ENTRY_FIELDS), ["url_bucket", "batch"])

    # Changes

    def counts(self) -> DataFrame:
        """Current articles by time and source: scraped_at, source, articles."""
        path = self._path("changes", self._version("changes"))
        changes = self.spark.read.schema(ddl(CHANGE_FIELDS)).parquet(path)
        summed = changes.groupBy("scraped_at", "source").agg(F.sum("articles").alias("articles"))
        return summed.where(F.col("articles") != 0)

    def add_changes(self, added: DataFrame, replaced: DataFrame, batch: str) -> None:
        """What a batch adds and what it takes the place of: rows of scraped_at and source."""
        signed = added.select("scraped_at", "source", F.lit(1).alias("n")).unionByName(
            replaced.select("scraped_at", "source", F.lit(-1).alias("n"))
        )
        self._write(self._summed(signed, batch), self._path("changes", self._version("changes")), ["batch"], "dynamic")

    def renew_changes(self, current: DataFrame) -> None:
        self._renew("changes", self._summed(current.withColumn("n", F.lit(1)), COUNTED), ["batch"])

    def _summed(self, rows: DataFrame, batch: str) -> DataFrame:
        summed = rows.groupBy("scraped_at", "source").agg(F.sum("n").alias("articles"))
        return conform(summed.withColumn("batch", F.lit(batch)), CHANGE_FIELDS)

    # Saves

    def numbers(self) -> dict[str, int]:
        """The number of every batch among the saves."""
        named = (name.split(".", 1) for name in names_in(self.spark, f"{self.folder}/saves"))
        return {batch: int(number) for number, batch in named}

    def number(self, batch: str, number: int) -> None:
        make_folder(self.spark, f"{self.folder}/saves/{number:012d}.{batch}")

    def begin(self, work: str) -> None:
        make_folder(self.spark, f"{self.folder}/open/{work}")

    def end(self, work: str) -> None:
        remove_folder(self.spark, f"{self.folder}/open/{work}")

    def unfinished(self) -> list[str]:
        return names_in(self.spark, f"{self.folder}/open")
