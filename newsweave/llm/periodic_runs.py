"""Periodic runs of words: stretches that repeat a passage back to back.

A run of period p and length l is a maximal pair: its words from the start, and the same
l - p words again p further on, which agree neither one word to the left nor one to the right.
So runs are read off the maximal pairs of a text, by depth and distance alone, and
none has to be extended.

The words' suffix array (by doubling) and its common prefixes give the tree of LCP intervals,
visited from the leaves up. An interval holds the positions below it in order, each in the
class of the word to its left. Where two children join, a pair of positions of different
children and different classes is a maximal pair. Only pairs whose distance is small against
their depth can be runs, and these are sparse: within such a distance all positions of an
interval lie on one progression, of which the first alone can differ in class, so
one look to either side finds the partner in the other classes. The smaller
child is looked up in the larger and merged into it: n log n for any text.

Words are runs of anything but blanks (space, tab to carriage return). A null or empty text has
no words, no runs, and the empty collapsed text. Rows are taken one by one: repeated rows and
ids give repeated results, and other columns are kept. Columns named like a result are replaced.
"""

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.llm.columns import WORD, let

# A run has at least so many words, and as many periods.
LEAST = 24
PERIODS = 3
# Bytes of text whose results are held before they are returned.
PART_BYTES = 1 << 21
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def suffixes(ids: np.ndarray, depth: int) -> np.ndarray | None:
    """The suffix array of small numbers; None if no ``depth`` of them repeat."""
    size, reach = len(ids), 1
    ranks, known = ids, int(ids.max()) + 1
    # Two places rank alike only if as many words as ``reach`` are the same from both.
    while known < size:
        after = np.zeros(size, np.int64)
        after[: max(size - reach, 0)] = ranks[reach:] + 1
        kept, ranks = np.unique(ranks * (known + 1) + after, return_inverse=True)
        known, reach = len(kept), reach * 2
    return None if reach <= depth else np.argsort(ranks)


def common_prefixes(ids: list[int], order: list[int]) -> list[int]:
    """Words that each suffix of the array shares with the one before it; the first has none."""
    size = len(ids)
    place, shared, same = [0] * size, [0] * size, 0
    for at, start in enumerate(order):
        place[start] = at
    for start in range(size):
        if place[start] == 0:
            same = 0
            continue
        other = order[place[start] - 1]
        most = size - max(start, other)
        while same < most and ids[start + same] == ids[other + same]:
            same += 1
        shared[place[start]] = same
        same = max(same - 1, 0)
    return shared


class Pairs:
    """Maximal pairs (start, later start, depth) whose distance makes them runs."""

    def __init__(self, ids: list[int], periods: int) -> None:
        self.left = [-1, *ids]  # the class of a position: the word before it, none at the start
        self.share = periods - 1
        self.found: list[tuple[int, int, int]] = []

    def join(self, one: list[int], other: list[int], depth: int) -> list[int]:
        """The positions of two children of an interval, in order, once their pairs are found."""
        few, many = (one, other) if len(one) < len(other) else (other, one)
        within, left, size = depth // self.share, self.left, len(many)
        for at in few:
            low = bisect_left(many, at - within)
            if low < size and many[low] < at and left[many[low]] != left[at]:
                self.found.append((many[low], at, depth))
            high = bisect_right(many, at + within) - 1
            if high >= 0 and many[high] > at and left[many[high]] != left[at]:
                self.found.append((at, many[high], depth))
        for at in few:
            insort(many, at)
        return many

    def climb(self, order: list[int], shared: list[int], least: int) -> None:
        """Visit the intervals of at least ``least`` words from the leaves up."""
        open_: list[tuple[int, list[int]]] = []
        child: list[int] = []
        for start, depth in zip([*order, -1], [*shared, 0], strict=True):
            while open_ and open_[-1][0] > depth:
                own, held = open_.pop()
                child = self.join(held, child, own)
            if depth >= least:
                if open_ and open_[-1][0] == depth:
                    child = self.join(open_.pop()[1], child, depth)
                open_.append((depth, child))
            child = [start]


def runs_of(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence of small numbers, by start, then period."""
    # A pair of depth d and distance p <= d / (periods - 1) spans d + p words.
    depth = max(1, -(-least * (periods - 1) // periods))
    order = suffixes(ids, depth) if len(ids) >= max(least, periods) else None
    if order is None:
        return []
    pairs, listed, starts = Pairs(ids.tolist(), periods), ids.tolist(), order.tolist()
    pairs.climb(starts, common_prefixes(listed, starts), depth)
    smallest: dict[tuple[int, int], int] = {}
    for start, later, common in pairs.found:
        period = later - start
        if common + period >= least:
            span = (start, common + period)
            smallest[span] = min(period, smallest.get(span, period))
    return sorted((start, length, period) for (start, length), period in smallest.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Small numbers that tell the words apart."""
    number = {word: at for at, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change[:-1])
    return b" ".join([words[at] for at in np.flatnonzero(covered == 0).tolist()])


def periodic_runs(documents: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """``documents`` with n_words, ``runs`` (start, length, period) and the ``collapsed`` text.

    A run is a stretch of at least ``least`` words and ``periods`` (2 or more) times its smallest
    period that no neighbouring word extends; its words after the first period are left
    out of the collapsed text. A map over the rows.
    """
    if periods < 2:
        raise ValueError("a run repeats its period at least once")
    others = [name for name in documents.columns if name not in ("n_words", "runs", "collapsed")]
    schema = T.StructType([documents.schema[name] for name in others])
    schema = schema.add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in RUN.names]))

    def results(rows: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        sizes, runs, texts = zip(*found, strict=True)
        listed = [[dict(zip(RUN.names, run, strict=True)) for run in own] for own in runs]
        added = [pa.array(sizes, pa.int64()), pa.array(listed, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*[rows.column(name) for name in others], *added], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            first, held, found = 0, 0, []
            for at in range(batch.num_rows):
                text = texts[at].as_py() or b""
                words = text.split()
                own = runs_of(numbered(words), least, periods)
                found.append((len(words), own, collapsed(words, own)))
                held += len(text)
                if held >= PART_BYTES:
                    yield results(batch.slice(first, at + 1 - first), found)
                    first, held, found = at + 1, 0, []
            if found:
                yield results(batch.slice(first), found)

    return documents.select(*others).mapInArrow(run, schema)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The text of one document in ten with its words repeated from a place on; others unchanged.

    Place and period follow from the hash of the id (null: the empty text).
    """
    mixed = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    group = F.floor(mixed / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda word: word != "")

    def repeat(held: Column) -> Column:
        size = F.size(held).cast("long")
        start = group % size
        period = F.lit(1) + F.floor((size - start) / (F.lit(3) + group % 8))
        place = F.sequence(F.lit(0).cast("long"), size - 1)
        moved = F.transform(
            place, lambda i: F.get(held, F.when(i >= start, start + (i - start) % period).otherwise(i).cast("int"))
        )
        return F.array_join(moved, " ")

    return F.when((mixed % 10 == 0) & text.rlike(WORD), let(words, repeat)).otherwise(text)


def run_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent and the hashes of the runs and the collapsed text."""
    given = documents.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    # Of equal exponents the first by start, then period, stays: runs come in that order.
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda top, run: F.when(run["length"] * top["period"] > top["length"] * run["period"], run).otherwise(top),
    )
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", *[run[n].cast("string") for n in RUN.names]), F.lit("\n")))
    return (
        periodic_runs(given)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
