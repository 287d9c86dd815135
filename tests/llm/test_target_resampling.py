"""Resampling against a plain computation, and its checksums against the library's."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsweave.llm import target_resampling as resampling

SCHEMA = "doc_id long, text string, id string, row int, rank string, _row int, weight double"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=60), st.integers(0, 3))
def test_checksums(features, long):
    features = features + [bytes(range(256)) * (at + 2) for at in range(long)] * 2
    assert resampling.checksums(features).tolist() == [zlib.crc32(each) for each in features]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    lower = text.translate({at: at + 32 for at in range(65, 91)})
    wanted = [word.encode() for word in WORD.findall(lower)]
    assert resampling.words_of(text.encode()) == wanted


def features(text, longest):
    words = WORD.findall((text or "").translate({at: at + 32 for at in range(65, 91)}))
    return len(words), [" ".join(words[at : at + n]) for n in range(1, longest + 1) for at in range(len(words) - n + 1)]


def by_hand(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    corpus = Counter(bucket(f) for _, text in rows for f in features(text, longest)[1])
    wanted = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    held, aimed = sum(corpus.values()), sum(wanted.values())
    found, able = [], []
    for place, (doc_id, text) in enumerate(rows):
        words, own = features(text, longest)
        total = sum(
            math.floor(1000 * math.log((wanted[b] + 1) * (held + buckets) / ((corpus[b] + 1) * (aimed + buckets))))
            for b in map(bucket, own)
        )
        weight = total // len(own) if own else 0
        drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 2**32)))
        found.append([doc_id, len(own), weight, score, None])
        if words >= least:
            able.append((-score, doc_id is None, doc_id or 0, place))
    for rank, (*_, place) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        found[place][4] = rank
    return sorted(map(tuple, found), key=repr)


def some(rng, count):
    words = [f"w{at}" for at in range(40)] + ["É", "naïve", "x" * 700, "日本語", "Ab", "aB"]
    texts = ["", None, "?!", "one two", "日" * 3000]
    rows = [(at, rng.choice(["  ", ",", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))) for at in range(count)]
    return rows + [(None, text) for text in texts] + rows[:9] + [(3, "other text " * 15), (None, rows[0][1])]


def make(spark, rows):
    return spark.createDataFrame([(*row, "x", 7, "r", 9, 0.5) for row in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rule", [{}, {"longest": 3, "buckets": 64, "percent": 35, "least": 5}, {"least": 0, "percent": 100, "seed": 5}])
def test_by_hand(spark, monkeypatch, rule):
    monkeypatch.setattr(resampling, "PART_BYTES", 900)
    rng = random.Random(8)
    rows, target = some(rng, 150), ["w1 w2 w3 W1", None, "", "É naïve, w2-w3"]
    texts = spark.createDataFrame([(text, 1) for text in target], "text string, doc_id int")
    found = resampling.resampled(make(spark, rows), texts, **rule)
    assert {f.dataType.simpleString() for f in found.schema} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(rows, target, **rule)


def test_draw(spark):
    rng = random.Random(3)
    rows, target = some(rng, 90), ["w1 w2 w3"]
    given = make(spark, rows)
    texts = spark.createDataFrame([(text,) for text in target], "text string")
    kept = resampling.draw(given, texts, percent=30)
    assert kept.schema == given.schema
    texts_by_id = Counter(row.doc_id for row in kept.collect())
    assert texts_by_id == Counter(row[0] for row in by_hand(rows, target, percent=30) if row[4] is not None)


def test_empty_tables(spark):
    none, texts = make(spark, []), spark.createDataFrame([], "text string")
    assert resampling.resampled(none, texts).collect() == []
    rows = [(1, "a b c " * 10), (2, None)]
    found = resampling.resampled(make(spark, rows), texts, percent=100)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, [], percent=100)


def test_target_is_drawn(spark):
    """Documents made of the target's words come before all others, near enough."""
    rng = random.Random(1)
    rows = [(at, " ".join(rng.choices([f"{'t' if at % 10 == 0 else 'w'}{k}" for k in range(30)], k=50))) for at in range(600)]
    texts = spark.createDataFrame([(" ".join(f"t{k}" for k in range(30)) * 9,)], "text string")
    drawn = [row.doc_id for row in resampling.resampled(make(spark, rows), texts).where("rank is not null").collect()]
    assert len(drawn) == 60
    assert np.mean([doc_id % 10 == 0 for doc_id in drawn]) > 0.7
