"""Importance resampling towards a target: documents whose features look like the target's are likelier.

Features are runs of 1 to ``longest`` words, hashed by CRC-32 into buckets. A bucket's gain is the log ratio
of its smoothed shares in the target and in the corpus, in thousandths; a document's weight is the
floored mean of the gains of its features. A noise that follows from a seed and the id alone is added
(Gumbel's, also in thousandths), and the highest sums are drawn: a sample without
replacement in proportion to the weights, the same in every run.

The distinct features of some texts are grouped by their length in bytes; each group is a matrix
of bytes with a row per feature, and one step along its columns moves all its checksums on. What
comes out is scattered back to the features as they stand in the texts.

Counts of corpus and target cover all their texts. What reaches the driver is one number per
bucket of each, whatever their size. The texts are read twice, once to count and once to
weigh; neither pass shuffles them. Ranks come from a range sort of narrow rows.

A text is lower-cased in ASCII; words are runs of digits, letters a to z and characters beyond ASCII.
Null and empty texts have no features, weight 0, and are too short to be drawn (unless ``least``
is 0). A null id counts as the empty text in the noise and comes last among ties; rows that repeat
an id have its noise and are drawn one by one. Without target texts all gains are those of an
empty target; without documents there are no rows. Other columns take no part here;
``draw`` keeps them.
"""

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.words import plain_row_name
from newsweave.operators.ranking import number_rows
from newsweave.session import write_out

BUCKETS = 10_000
# Texts are taken together up to so many bytes; a longer one is taken alone.
PART_BYTES = 1 << 21
# Longer features, too rare to make a matrix, are hashed one by one.
LONGEST_ROW = 512
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
LETTERS = bytes(at for at in range(256) if at >= 0x80 or chr(at).isalnum())
# Letters in lower case, all else a blank.
WORD_BYTES = bytes(ord(chr(at).lower()) if at < 0x80 and at in LETTERS else at if at in LETTERS else 0x20 for at in range(256))
WEIGHED = "id long, row long, n_words long, n_features long, weight long"


def _checksum_steps() -> np.ndarray:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1)
    return step


STEPS = _checksum_steps()
ALL_ONES = np.uint32(0xFFFFFFFF)


def checksums(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of every feature, by matrices of equal length."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    joined = np.frombuffer(b"".join([features[at] for at in order.tolist()]), np.uint8)
    out = np.zeros(len(features), np.uint32)
    begin, at = 0, 0
    for length, count in zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True)), strict=True):
        own = order[begin : begin + count]
        rows = joined[at : at + length * count].reshape(count, length)
        begin, at = begin + count, at + length * count
        if length > LONGEST_ROW:
            out[own] = [crc32(row) for row in rows]
            continue
        held = np.full(count, ALL_ONES)
        for column in rows.T:
            held = STEPS[(held ^ column) & np.uint32(255)] ^ held >> np.uint32(8)
        out[own] = held ^ ALL_ONES
    return out


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a blank."""
    if longest == 1:
        return words
    sizes = range(1, min(longest, len(words)) + 1)
    return [b" ".join(words[at : at + size]) for size in sizes for at in range(len(words) - size + 1)]


def hashed(texts: list[bytes | None], longest: int, buckets: int) -> tuple[list[int], list[int], np.ndarray]:
    """Words and features of each text, and the buckets of all features in turn."""
    words = [words_of(text) for text in texts]
    features = [features_of(own, longest) for own in words]
    number: dict[bytes, int] = {}
    for feature in chain.from_iterable(features):
        number.setdefault(feature, len(number))
    counts = [len(own) for own in features]
    place = np.fromiter(map(number.__getitem__, chain.from_iterable(features)), np.int64, sum(counts))
    found = (checksums(list(number)) % np.uint32(buckets)).astype(np.int64)
    return [len(own) for own in words], counts, found[place]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts of a batch in parts of about PART_BYTES, each with its first row."""
    held, first, size = [], 0, 0
    for at, text in enumerate(batch.column("text").cast(pa.binary())):
        held.append(text.as_py())
        size += len(held[-1] or b"")
        if size >= PART_BYTES:
            yield first, held
            held, first, size = [], at + 1, 0
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts fall into it. Summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held in _parts(batch):
                total += np.bincount(hashed(held, longest, buckets)[2], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": met.astype(np.int64), "n": total[met]})

    counted = texts.select("text").mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, buckets: int) -> list[int]:
    """A count for every bucket; one row of each at most reaches the driver."""
    out = [0] * buckets
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """The gain of every bucket in thousandths."""
    held, wanted, buckets = sum(corpus), sum(target), len(corpus)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (held + buckets) / ((s + 1) * (wanted + buckets))))
            for s, t in zip(corpus, target, strict=True)
        ],
        np.int64,
    )


def weighed(documents: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """id, row, n_words, n_features and weight of rows (id, row, text). A map over the rows."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for first, held in _parts(batch):
                words, counts, found = hashed(held, longest, len(gain))
                ends = np.cumsum(counts)
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                sums = sums[ends] - sums[ends - counts]
                rows = batch.slice(first, len(held))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": rows.column("id"),
                        "row": rows.column("row"),
                        "n_words": pa.array(words, pa.int64()),
                        "n_features": pa.array(counts, pa.int64()),
                        "weight": np.where(ends == ends - counts, 0, sums // np.maximum(counts, 1)),
                    }
                )

    return documents.select("id", "row", "text").mapInArrow(run, WEIGHED)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(float(1 << 32)))))


def _ranked(
    rows: DataFrame, target: DataFrame, longest: int, buckets: int, least: int, percent: int, seed: int
) -> DataFrame:
    """The rows (id, row, text) weighed, with score and rank; the rank of rows not drawn is null."""
    corpus = _collected(bucket_counts(rows, longest, buckets), buckets)
    wanted = _collected(bucket_counts(target, longest, buckets), buckets)
    scored, _ = write_out(
        weighed(rows, gains(corpus, wanted), longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed)),
        "weighed",
    )
    long_enough = F.col("n_words") >= least
    drawn = scored.where(long_enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    placed = number_rows(scored.where(long_enough), order, "rank")
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    documents: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    least: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank (null: not drawn).

    Of the documents of at least ``least`` words the ``percent`` with the highest scores are drawn,
    ties by doc_id. ``target`` has a column ``text``.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), "text"
    )
    found = _ranked(rows, target, longest, buckets, least, percent, seed)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def draw(documents: DataFrame, target: DataFrame, **rule: int) -> DataFrame:
    """The drawn ``documents``; columns stay. Options as of ``resampled``."""
    options = {"longest": 1, "buckets": BUCKETS, "least": 20, "percent": 10, "seed": 2024} | rule
    own = plain_row_name(documents.columns)
    rows, _ = write_out(documents.withColumn(own, F.monotonically_increasing_id()), "rows")
    given = rows.select(F.col("doc_id").cast("long").alias("id"), F.col(own).alias("row"), "text")
    drawn = _ranked(given, target, **options).where("rank is not null").select(F.col("row").alias(own))
    return rows.join(drawn, own, "left_semi").select(*[F.col(f"`{name}`") for name in documents.columns])
