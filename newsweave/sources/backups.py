"""Backups of snapshots that copy only what changed since the last one.

Every run's snapshot is known by its content: the number of its lines and a checksum that does not
depend on their order. A backup lists the content of all snapshots and where a copy of each lies,
and copies those that no earlier backup holds. The list is written last, so a backup that did not end
is not there. Restoring reads the copies a list names.
"""

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.session import broadcast_if_small, materialize

LISTED = "run_date date, line_count bigint, checksum decimal(38,0), held_by string, backup_ts string"
CONTENT = ["run_date", "line_count", "checksum"]


def contents(lines: DataFrame) -> DataFrame:
    """Lines and checksum of every snapshot, from its lines."""
    return lines.groupBy("run_date").agg(
        F.count("*").alias("line_count"),
        F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"),
    )


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all snapshots with their run's date, as text."""
    return spark.read.schema("value string, run_date date").text(folder)


class SnapshotBackups:
    """The backups in a folder: ``copies`` of snapshots and ``lists`` of their contents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def lists(self) -> DataFrame:
        """What every backup lists."""
        try:
            return self.spark.read.schema(LISTED).parquet(f"{self.folder}/lists")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], LISTED)

    def _copies(self) -> DataFrame:
        return self.spark.read.schema("value string, held_by string, run_date date").text(f"{self.folder}/copies")

    def take(self, source: str, taken_at: datetime) -> DataFrame:
        """Back up all snapshots; returns the check as one row.

        The source is read once for its contents, and the changed snapshots once more. The check
        compares what was copied with the contents listed.
        """
        name = taken_at.strftime("%Y%m%d_%H%M%S")
        lines = read_snapshots(self.spark, source)
        held = self.lists().groupBy(*CONTENT).agg(F.min("held_by").alias("held_by"))
        # One short row per snapshot.
        found = materialize(contents(lines).join(held, CONTENT, "left"))
        new = materialize(found.where("held_by is null").select(*CONTENT))
        if not new.isEmpty():
            days = broadcast_if_small(new.select("run_date"))
            # Copies are kept compressed: plain lines take several times the space of the articles.
            lines.join(days, "run_date", "left_semi").select("value", "run_date", F.lit(name).alias("held_by")).write.mode(
                "overwrite"
            ).option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(
                "held_by", "run_date"
            ).text(f"{self.folder}/copies")
            copied = materialize(contents(self._copies().where(F.col("held_by") == name)))
        else:
            copied = new
        listed = found.select(*CONTENT, F.coalesce("held_by", F.lit(name)).alias("held_by"), F.lit(name).alias("backup_ts"))
        wrong = new.join(copied, CONTENT, "left_anti").count()
        if not wrong:
            listed.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "backup_ts"
            ).parquet(f"{self.folder}/lists")
        lines_of = F.coalesce(F.sum("line_count"), F.lit(0))
        return found.agg(
            F.count("*").alias("snapshots"),
            lines_of.alias("source_rows"),
            F.lit(new.count()).cast("bigint").alias("copied_snapshots"),
            F.lit(copied.agg(lines_of).first()[0]).cast("bigint").alias("copied_rows"),
            F.lit(wrong == 0).alias("identical"),
        )

    def restore(self, taken_at: datetime) -> DataFrame:
        """Lines of the snapshots as they were at a backup, with their run's date."""
        listed = self.lists().where(F.col("backup_ts") == taken_at.strftime("%Y%m%d_%H%M%S"))
        return self._copies().join(broadcast_if_small(listed.select("held_by", "run_date")), ["held_by", "run_date"], "left_semi").select(
            "value", "run_date"
        )
