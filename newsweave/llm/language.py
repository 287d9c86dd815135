"""Language identification by error-correcting output codes.

Every learned language has a codeword; one binary classifier per bit tells, from hashed
byte n-grams of the lower-cased text, on which side of its split the text's language
stands. The language whose codeword costs least, weighted by the logistic loss of the
classifiers' margins, is chosen; a narrow lead over the second is flagged.

The classifiers are log-odds of n-gram frequencies, every language weighing the same in its side
of a split. They are fitted on all training rows: counts are summed by Spark, and what
reaches the driver is one row per language and bin, whatever the input's size.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if no
language could be learned. Ties go to the language first in code point order.
"""

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
BINS = 1 << 12
# Up to so many languages all splits are used; beyond, so many bits for each doubling.
EXHAUSTIVE = 6
BITS_PER_DOUBLING = 12
SMOOTHING = 0.5
# Grams' worth of evidence that a margin counts at most, so that long texts stay comparable.
EVIDENCE = 60
# A lead of less than this share of the code's length is ambiguous.
NARROW = 0.05


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The row's fold by its id alone; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def gram_bins(text: str) -> np.ndarray:
    """Bins of all n-grams of the text's bytes; each order has bins of its own."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8).astype(np.uint32)
    out, hashed = [], np.zeros(len(data), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        hashed = hashed[: len(data) - order + 1] if order > 1 else hashed
        if not len(hashed):
            break
        hashed = (hashed + data[order - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if order in ORDERS:
            place = hashed >> np.uint32(32 - BINS.bit_length() + 1)
            out.append(place + np.uint32(ORDERS.index(order) * BINS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def gram_counts(text: str) -> np.ndarray:
    return np.bincount(gram_bins(text), minlength=BINS * len(ORDERS))


def codewords(count: int) -> np.ndarray:
    """One row of -1 and 1 per language; no column is constant, all rows differ."""
    if count < 2:
        return np.ones((count, 0))
    if count <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=count - 1)][1:]
        return np.array(columns, dtype=np.float64).T
    bits = math.ceil(BITS_PER_DOUBLING * math.log2(count))
    drawn = np.random.default_rng(count)
    while True:
        code = drawn.choice([-1.0, 1.0], size=(count, bits))
        if len(np.unique(code, axis=0)) == count and (abs(code.sum(axis=0)) < count).all():
            return code


@dataclass(frozen=True)
class Model:
    """Languages, their codewords (by row) and the classifiers' weights (bin by bit)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the lead is narrow."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = gram_counts(text).astype(np.float32)
        margins = counts @ self.weights * (EVIDENCE / max(EVIDENCE, counts.sum()))
        losses = np.logaddexp(0, -self.code * margins.astype(np.float64)).sum(axis=1)
        order = np.argsort(losses, kind="stable")
        likely = np.exp(losses[order[0]] - losses)
        lead = losses[order[1]] - losses[order[0]]
        return (
            self.languages[order[0]],
            float(1 / likely.sum()),
            bool(lead < NARROW * self.code.shape[1]),
        )


def learn(labelled: DataFrame) -> Model:
    """A model from all rows of ``text`` and ``lang`` that have both."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BINS * len(ORDERS), dtype=np.int64)
                sums[lang] += gram_counts(text)
        for lang, counts in sums.items():
            bins = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bin": bins, "n": counts[bins]})

    rows = (
        labelled.select("text", "lang")
        .where("text is not null and lang is not null and text != ''")
        .mapInPandas(count, "lang string, bin int, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows["lang"].unique())
    share = np.full((len(languages), BINS * len(ORDERS)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    share[rows["lang"].map(place).to_numpy(dtype=int), rows["bin"].to_numpy(dtype=int)] += rows["n"]
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    sides = [np.log(share[code[:, bit] > 0].mean(0)) - np.log(share[code[:, bit] < 0].mean(0)) for bit in range(code.shape[1])]
    weights = np.array(sides, dtype=np.float32).T if sides else np.zeros((share.shape[1], 0), np.float32)
    return Model(languages, code, np.ascontiguousarray(weights))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred, score and ambiguous, from the text alone. A map."""
    parts = (model.languages, model.code, model.weights)
    shared = documents.sparkSession.sparkContext.broadcast(parts)

    added = ("lang_pred", "score", "ambiguous")
    kinds = pa.string(), pa.float64(), pa.bool_()

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for texts in batches:  # one text at a time is a Python object
            columns = zip(*(own.predict(text.as_py()) for text in texts), strict=True)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], added)

    # A condition on a prediction would predict again below it, in another Python worker beside the first; Spark
    # moves no condition through what it takes for non-deterministic.
    once = predict.asNondeterministic()
    others = [name for name in documents.columns if name not in added]
    return (
        documents.select(*others)
        .withColumn("_p", once("text"))
        .select(*others, *[F.col(f"_p.{name}").alias(name) for name in added])
    )


def predicted_languages(documents: DataFrame) -> DataFrame:
    """Every document's language, learned from the folds that are not held out."""
    held_out = fold(F.col("doc_id")) == 0
    model = learn(documents.where(~held_out))
    found = identify(documents.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
