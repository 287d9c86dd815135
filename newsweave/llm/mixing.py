"""Mixing sources to target weights.

Words are summed per source; sources in code point order, null last, take the weights in
turn and share all words by them, but no source above ``most`` times its own. A source's
repetition rate is its target over its words: each document is taken floor(rate) times, and
once more if a draw seeded by its id falls below the fraction.

Null texts hold no words. A source without words has the target 0 and rate 0. Rows that share an
id share the draw; a null id draws as the empty text. Without rows there is no source.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.columns import WORD
from newsweave.operators.ranking import number_rows
from newsweave.session import broadcast_if_small, write_out

# The weights that sources take in turn, and the largest repetition.
WEIGHTS = (5, 2, 1)
MOST = 3
DRAWS = 1 << 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(DRAWS)


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """Per source its words and target, from rows of source and size.

    The rows are summed per source before the shuffle. Sources at their bound keep it and
    the rest is shared again among the others until none is above; each round is one
    aggregate over the table of sources, of which only sums reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = number_rows(totals, [F.col("source").isNull(), F.col("source")], "place")
    turn = ((F.col("place") - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)
    sources, _ = write_out(placed.select("source", "source_size", weight.alias("weight")), "sources")
    bound = F.col("source_size") * most
    words, shares = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (words or 0) / (shares or 1), 0
    while True:
        at_bound = sources.where(bound <= F.col("weight") * F.lit(level))
        held, taken, count = at_bound.agg(
            F.coalesce(F.sum(bound), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")
        ).first()
        if count == full or taken == shares:
            break
        full, level = count, (words - held) / (shares - taken)
    share = F.col("weight") * F.lit(level)
    target = F.when(bound <= share, bound.cast("double")).otherwise(share)
    return sources.select("source", "source_size", target.alias("target"))


def _planned(documents: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``documents`` with _size, _target and _copies.

    Sources join by broadcast when measured small, else by a join whose skew adaptive
    execution splits.
    """
    plan = targets.select(
        F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target")
    )
    joined = documents.join(
        broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    rate = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("_copies", F.floor(rate) + extra)


def with_copies(documents: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """``documents`` with source_size, target and copies: how often the mix takes each."""
    added = ("source_size", "target", "copies")
    kept = [name for name in documents.columns if name not in added]
    return _planned(documents.select(*kept), targets, seed).select(
        *kept,
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
    )


def mix(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed documents: each row as often as the mix takes it."""
    sized = documents.select("source", word_count(F.col("text")).alias("size"))
    planned = _planned(documents, source_targets(sized), seed)
    repeats = F.array_repeat(F.lit(1), F.col("_copies").cast("int"))
    return planned.select(*documents.columns, F.explode(repeats).alias("_copy")).drop("_copy")
