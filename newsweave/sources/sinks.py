"""Snapshots of articles as JSON lines, and backups of snapshots."""

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from newsweave.functions.dates import iso_text


def save_json(articles: DataFrame, path: str, run_date: date) -> str:
    """Write all articles of a run as UTF-8 JSON lines; times become ISO text.

    Each run has its own folder, replaced when the run is repeated.
    """
    target = f"{path.rstrip('/')}/run_date={run_date.isoformat()}"
    times = {
        field.name: iso_text(F.col(field.name))
        for field in articles.schema
        if isinstance(field.dataType, TimestampNTZType)
    }
    articles.withColumns(times).write.mode("overwrite").json(target)
    return target


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum, as one row."""
    row = F.xxhash64(*[F.col(name) for name in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("checksum"),
    )


def backup(spark: SparkSession, source: str, backups: str, taken_at: datetime) -> DataFrame:
    """Copy all JSON snapshots to a folder named by time; returns the check.

    The check has one row: rows and checksum of source and copy, and whether
    they agree. Lines are copied as text, so nothing is reinterpreted.
    """
    target = f"{backups.rstrip('/')}/backup_ts={taken_at:%Y%m%d_%H%M%S}"
    snapshots = spark.read.text(source)
    snapshots.write.mode("errorifexists").partitionBy("run_date").text(target)
    copied = fingerprint(spark.read.text(target)).select(
        F.col("row_count").alias("copied_rows"), F.col("checksum").alias("_copied")
    )
    original = fingerprint(snapshots)
    return original.select(
        F.col("row_count").alias("source_rows"),
        copied.select("copied_rows").scalar().alias("copied_rows"),
        (F.col("checksum") == copied.select("_copied").scalar()).alias("identical"),
    )
