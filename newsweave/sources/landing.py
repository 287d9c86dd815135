"""Landed payload files as tables of whole documents.

Files lie under one folder per source or category, ``<root>/name=<source>/…`` or
``<root>/category=<category>/…``; the folder gives the column.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per file: folder columns, ``payload_id`` and the whole ``payload``.

    The id is the time the file was landed, then its path in short: documents of one
    source arrive in the order they were landed, the same in every run.
    """
    files = spark.read.text(root, wholetext=True)
    folders = [name for name in files.columns if name != "value"]
    return files.select(
        *folders,
        (
            F.unix_seconds("_metadata.file_modification_time") * (1 << 20)
            + F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 20))
        ).alias("payload_id"),
        F.col("value").alias("payload"),
    )
