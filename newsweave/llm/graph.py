"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.session import write_out


def components(links: DataFrame) -> DataFrame:
    """Every node of ``links`` (columns a, b) with the smallest node it reaches: node, component.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the
    smallest it knows, until every component is one star. A round is two grouped minima
    (summed per task before the shuffle) and two joins; no group is gathered, and only a
    count and a checksum reach the driver. Links of a node to itself and nulls are left out.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    links = links.where(F.col("a") != F.col("b")).select(larger.alias("a"), smaller.alias("b")).distinct()
    links, _ = write_out(links, "links")
    before = None
    while (now := _checksum(links)) != before:
        before = now
        links, _ = write_out(_small_star(_large_star(links)).distinct(), "links")
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def _checksum(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.sum(mixed)).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))
