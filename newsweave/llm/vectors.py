"""Vectors as packed blocks, dealt to shards and query parts.

A shard is a bounded number of vectors whose index one task can hold; queries are dealt into
parts of a bounded number, and every part meets every shard of its length once.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At least so many shards, and at most so many vectors in each.
SHARDS = 8
SHARD_ROWS = 32_768
# Queries that meet a shard at once.
PART_ROWS = 16_384
BLOCK = "at int, ids binary, weights binary, vectors binary"


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null, infinite or undefined component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part. A null id takes no part."""
    return embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def shards_of(rows: int, fill: int = 1) -> int:
    """Shards for so many vectors; fewer than ``SHARDS`` if each would hold less than ``fill``."""
    few = SHARDS if fill == 1 else min(SHARDS, max(1, rows // fill))
    return max(few, -(-rows // SHARD_ROWS))


def parts_of(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def layout(rows: DataFrame, asked: Column, fill: int = 1) -> DataFrame:
    """Per length of ``vector``: its first shard and part, and how many of each it has.

    Vectors are compared within their own length, so each length has shards and parts of its
    own. One row per length that occurs reaches the driver.
    """
    counted = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("all"), F.count_if(asked).alias("asked"))
    placed, shard, part = [], 0, 0
    for length, every, some in sorted(map(tuple, counted.collect())):
        placed.append((length, shard, shards_of(every, fill), part, parts_of(some)))
        shard, part = shard + shards_of(every, fill), part + parts_of(some)
    names = "length int, shard int, shards int, part int, parts int"
    return rows.sparkSession.createDataFrame(placed, names)


def dealt(rows: DataFrame, places: DataFrame, kind: str) -> DataFrame:
    """``rows`` with ``at``: their ``shard`` or ``part``, by length and hash of the id."""
    mine = F.broadcast(places.select("length", F.col(kind).alias("_first"), F.col(f"{kind}s").alias("_count")))
    at = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_count")).cast("int")
    return rows.withColumn("length", F.size("vector")).join(mine, "length").withColumn("at", at)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of at, id, weight and vector, packed into ``BLOCK`` by ``at`` before any shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [
                (at, _bytes(own["id"], np.int64), _bytes(own["weight"], np.int64), np.stack(own["vector"]).astype(np.float64).tobytes())
                for at, own in batch.groupby("at")
            ]
            yield pd.DataFrame(packed, columns=["at", "ids", "weights", "vectors"])

    return rows.select("at", "id", "weight", "vector").mapInPandas(run, BLOCK)


def _bytes(values: pd.Series, kind: type) -> bytes:
    return values.to_numpy(kind).tobytes()


def unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and vectors of blocks, by id."""
    ids = np.frombuffer(b"".join(frame["ids"]), np.int64)
    weights = np.frombuffer(b"".join(frame["weights"]), np.int64)
    vectors = np.frombuffer(b"".join(frame["vectors"]), np.float64).reshape(len(ids), -1)
    order = np.lexsort((weights, ids))
    return ids[order], weights[order], vectors[order]


def meet(shards: DataFrame, queries: DataFrame, places: DataFrame, search: Callable, schema: str) -> DataFrame:
    """``search(shard rows, query blocks)`` for every shard and every part of queries of its length.

    Shards travel once per part and queries once per shard; a group is one of each.
    """

    def others(own: str, other: str) -> DataFrame:
        every = F.sequence(F.col(own), F.col(own) + F.col(f"{own}s") - 1)
        last = F.col(other) + F.col(f"{other}s") - 1
        return F.broadcast(places.select(F.explode(every).alias("at"), F.col(other).alias("_first"), last.alias("_last")))

    each = F.explode(F.sequence("_first", "_last"))
    left = shards.join(others("shard", "part"), "at").withColumn("part", each).drop("_first", "_last")
    right = queries.join(others("part", "shard"), "at").withColumnRenamed("at", "part").withColumn("at", each).drop("_first", "_last")
    return left.groupBy("at", "part").cogroup(right.groupBy("at", "part")).applyInPandas(search, schema)
