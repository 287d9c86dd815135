import math
import re

import pytest
from pyspark.sql import functions as F

from newsweave.llm import mixing


def expected_targets(sizes):
    """Water-filling, one source after the other at its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and shares and 3 * sizes[s] <= weight[s] * rest / shares}
        if not over:
            break
        full |= over
    return {s: 3.0 * sizes[s] if s in full else weight[s] * rest / shares for s in order}


SIZES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1, "b": 5, "c": 1000, "d": 3, None: 40, "Z": 7},
    {"a": 10},
    {"a": 0, "b": 9, "é": 2, "z": 0, "\U0001f642": 5, "￮": 1},
    {"a": 0, "b": 0},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_targets(spark, sizes):
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"))
    found = {r.source: (r.source_size, r.target) for r in got.collect()}
    for source, target in expected_targets(sizes).items():
        assert found[source][0] == sizes[source]
        assert math.isclose(found[source][1], target, abs_tol=1e-9)
    assert math.isclose(sum(t for _, t in found.values()), sum(sizes.values()), abs_tol=1e-6)


def test_documents(spark, tables):
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    sized = frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.with_copies(sized, mixing.source_targets(sized)).collect()
    texts = {r.doc_id: r.text for r in frame.collect()}
    for row in got:
        assert row.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id]))
        rate = row.target / row.source_size
        assert row.copies in (math.floor(rate), math.floor(rate) + 1) and row.copies <= 3
    again = mixing.with_copies(sized, mixing.source_targets(sized)).collect()
    assert sorted(got) == sorted(again)
    # Expected words come to the target of every source; the draw is fair over many ids.
    many = spark.range(20000).select(mixing.draw(F.col("id"), "mix").alias("d")).agg(F.avg("d"), F.count_if(F.col("d") < 0.25))
    mean, low = many.first()
    assert abs(mean - 0.5) < 0.01 and abs(low / 20000 - 0.25) < 0.01


def test_mix_repeats_rows(spark):
    rows = [(1, "a b c", "x", 7), (1, "a b c", "x", 7), (None, "d", None, 8), (2, None, "y", 9), (3, "", "y", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    sized = frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.source_targets(sized)
    want = mixing.with_copies(frame.drop("copies").withColumn("n", F.lit(1)), plan).agg(F.sum("copies")).first()[0]
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == want
    assert {r.copies for r in mixed.collect()} <= {7, 8}
    assert mixed.where("source = 'y'").count() == 0
    assert mixing.mix(frame.limit(0)).collect() == []
