"""Session helpers: the shared working folder and joins of measured size."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A join side is broadcast only when its measured text is at most this large.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 64


def working_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a single-machine master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="newsweave-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the working folder."""
    return f"{working_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once onto reliable storage and cut its lineage."""
    working_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Compute ``df`` once into a table in the working folder; returns it and its path.

    For wide rows read several times: later reads take only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _placed(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _placed(spark, folder)
    files.delete(path, True)


def make_folder(spark: SparkSession, folder: str) -> None:
    files, path = _placed(spark, folder)
    files.mkdirs(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, none if it is not there."""
    files, path = _placed(spark, folder)
    if not files.exists(path):
        return []
    return sorted(found.getPath().getName() for found in files.listStatus(path))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it is measured to be small.

    ``df`` must be cheap to read, such as materialized rows. A larger one is
    returned as it is, and joins by shuffling.
    """
    widths = [F.octet_length(F.col(name).cast("string")) for name in df.columns]
    width = sum((F.coalesce(each, F.lit(0)) for each in widths), F.lit(ROW_BYTES))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df
