"""Components of the shingle join against all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsweave.llm import shingle_join as join


def shingles(text, words):
    own = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    size = min(words, len(own))
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()


def brute(rows, words, num, den):
    sets = [(i, shingles(t, words)) for i, t in rows]
    label = list(range(len(sets)))
    for a, (i, x) in enumerate(sets):
        for b in range(a):
            j, y = sets[b]
            if x and y and i is not None and j is not None and den * len(x & y) >= num * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), own in zip(sets, label, strict=True):
        least[own] = min(least.get(own, i), i) if i is not None and least.get(own, i) is not None else i
    return sorted(((i, len(s), least[own] if i is not None else None) for (i, s), own in zip(sets, label, strict=True)), key=str)


def check(spark, rows, words, num, den):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS size")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in join.similar_documents(frame, words, num, den).collect()]
    assert sorted(got, key=str) == brute(rows, words, num, den)


def copies(rng, size, count, changes):
    """Texts that differ from one another in a few places."""
    base = [f"w{rng.randrange(300)}" for _ in range(size)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
        out.append(" ".join(own[: len(own) - rng.randrange(3)]))
    return out


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (1, 50)])
def test_edges(spark, words, num):
    texts = [None, "", " \t\n", "one", "One", "one two", "one two three", "one  two\x0bthree", "É é", "é É"]
    rng = random.Random(words)
    for size in (6, 12, 25, 60, 200):
        texts += copies(rng, size, 12, 1 + size // 30)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (None, None), (3, "one"), (3, "one two"), (5, None)]
    rng.shuffle(rows)
    check(spark, [r for r in rows if r[0] != 3 or r[1] == "one"], words, num, 100)


def test_documents(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 3, 90, 100)


def test_tiles_of_a_large_family(spark, monkeypatch):
    """Families over the size of a tile; a chain whose ends share little."""
    monkeypatch.setattr(join, "TILE", 8)
    rng = random.Random(4)
    texts = copies(rng, 80, 60, 3)
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join([*chain[i:], *(f"d{j}" for j in range(i))]) for i in range(0, 60, 2)]
    check(spark, list(enumerate(texts)), 3, 90, 100)


@pytest.mark.parametrize("two", [False, True])
def test_fine_points_lose_no_pair(two):
    """Components of all pairs whose bound allows a link, of one tile and between two."""
    rng = np.random.default_rng(7)
    points = rng.integers(0, 4, (300, join.FINE))
    points[150:] = points[:150] + (rng.random((150, join.FINE)) < 0.2) * (rng.random((150, 1)) < 0.5) * 2
    points[7] = 70_000
    sizes, side = points.sum(axis=1), (np.arange(300) // 50 % 2 if two else np.zeros(300, int))
    fine = [pa.compress(p.astype(np.int32).tobytes(), codec="zstd", asbytes=True) for p in points]
    stars = join.fine_stars(pd.DataFrame({"class": np.arange(300), "size": sizes, "fine": fine, "side": side}), 90, 100)
    forest, direct = join.Forest(np.arange(300)), join.Forest(np.arange(300))
    for a, b in stars.itertuples(index=False):
        forest.up[forest.root(a)] = forest.root(b)
    for a in range(300):
        for b in range(a):
            if (not two or side[a] != side[b]) and np.minimum(points[a], points[b]).sum() * 190 >= 90 * (sizes[a] + sizes[b]):
                direct.up[direct.root(a)] = direct.root(b)
    same = {(a, b) for a in range(300) for b in range(a) if forest.root(a) == forest.root(b)}
    assert same == {(a, b) for a in range(300) for b in range(a) if direct.root(a) == direct.root(b)}
    assert same


def test_a_passage_in_many_documents(spark, monkeypatch):
    """Documents that share a passage and little else; tiles of fine points smaller than the family."""
    monkeypatch.setattr(join, "TILE", 8)
    monkeypatch.setattr(join, "FINE_TILE", 16)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = [[*passage, *(f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 15, 30, 60])))] for _ in range(80)]
    texts += [[*own[:-1], "changed"] for own in texts[:20]]
    check(spark, list(enumerate(map(" ".join, texts))), 3, 90, 100)
    check(spark, list(enumerate(map(" ".join, texts))), 2, 70, 100)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert join.similar_documents(frame).collect() == []


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g", "k"), (2, "A b c d e f g", "k"), (3, "other", "k"), (4, None, "k"), (None, "a b c d e f g", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, size string")
    kept = join.one_of_each(frame)
    assert kept.columns == frame.columns
    # A row with an id goes before a copy without one.
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [2, 3, 4]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(90, 100), (80, 100), (2, 3)]), st.integers(0, 9))
def test_linked_sets_share_a_key(size, gone, more, share, seed):
    """Whatever two sets that link differ in, one key is the same."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, size + more).astype(np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[:size]), np.sort(pool[min(gone, size - 1) :])
    both = len(np.intersect1d(a, b))
    num, den = share
    if both * (num + den) >= num * (len(a) + len(b)) and both < max(len(a), len(b)):
        bands = join.Bands(num, den)
        assert len(np.intersect1d(bands.keys(a), bands.keys(b)))


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 700), st.integers(0, 9))
def test_boxes_lose_no_pair(count, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, (count, join.GROUPS))
    points[count // 2 :] = points[: count - count // 2] + rng.integers(0, 2, (count - count // 2, join.GROUPS)) * (rng.random((count - count // 2, 1)) < 0.5)
    sizes = points.sum(axis=1)
    left, right = join.candidates(points, sizes, 90, 100)
    found = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist(), strict=True)}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    passing = bound * 190 >= 90 * (sizes[:, None] + sizes[None])
    a, b = np.nonzero(np.triu(passing, 1))
    assert found == set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(found) == len(left)
