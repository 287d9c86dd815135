"""First-per-key, per-source caps, newest-first order and numbering.

Each rank filter keeps a literal bound, so Spark trims every map task to that
many rows per key before the shuffle: a key holding a third of all rows sends a
handful of rows per task, not its whole group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.functions.dates import newest_first_key, published_time
from newsweave.functions.text import present
from newsweave.session import materialize


def _first_per(df: DataFrame, keys: list, order: list, bound: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= bound)


def keep_first(articles: DataFrame, order: list, key: str = "url") -> DataFrame:
    """The first arrival per exact address; rows with a blank one are dropped.

    Blank addresses go before the shuffle, where they would be one huge key.
    """
    filled = articles.where(present(F.col(key)))
    return _first_per(filled, [key], order, 1, "_rank").drop("_rank")


def keep_last(articles: DataFrame, order: list, key: str = "url") -> DataFrame:
    """The last arrival per exact address; rows with a blank one are dropped."""
    return keep_first(articles, [F.col(column).desc() for column in order], key)


def cap_per_source(
    articles: DataFrame, keys: list, order: list, cap: Column | int, bound: int | None = None
) -> DataFrame:
    """The first ``cap`` rows per source; a null cap keeps none.

    A ``cap`` that varies by row may come with ``bound``, the largest value it takes,
    for the early trim; a cap over the bound ends the job rather than losing rows.
    """
    if isinstance(cap, int):
        return _first_per(articles, keys, order, cap, "_rank").drop("_rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = articles.withColumn("_rank", F.row_number().over(window))
    within = F.col("_rank") <= cap
    if bound is not None:
        ranked = ranked.where(F.col("_rank") <= bound)
        over = F.raise_error(F.lit(f"a cap exceeds its bound of {bound}")).cast("boolean")
        within = F.when(cap > bound, over).otherwise(within)
    return ranked.where(within).drop("_rank")


def with_published_time(articles: DataFrame, parse_rfc822: bool = False) -> DataFrame:
    return articles.withColumn(
        "published_ts", published_time(F.col("published"), parse_rfc822)
    )


def newest_first(articles: DataFrame, arrival: list) -> DataFrame:
    """Sort by publication time, newest first, undated last, ties by arrival."""
    return articles.orderBy(newest_first_key(F.col("published_ts")).desc(), *arrival)


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number all rows 1, 2, 3 … in a total order, without a single-task sort.

    Rows are range-partitioned and sorted, each keeps its place within its
    partition, and partition sizes (one small row each) give the offsets. The
    sorted rows are written once so that both uses see the same partitions.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed).withColumn("_part", F.shiftright("_place", 33))
    # One row per partition: the window over them is as small as the task list.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = F.col("_place") - F.shiftleft("_part", 33)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_part", "_place", "_offset")
    )
