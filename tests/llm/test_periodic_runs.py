"""Runs against brute force over all starts and periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsweave.llm import periodic_runs as periodic
from newsweave.llm.queries import QUERIES


def by_hand(ids, least=24, periods=3):
    """Maximal stretches of every period, kept under their smallest one."""
    size, found = len(ids), {}
    for period in range(1, size // periods + 1):
        at = 0
        while at + period < size:
            end = at
            while end + period < size and ids[end] == ids[end + period]:
                end += 1
            if end > at and end - at + period >= max(least, periods * period):
                found.setdefault((at, end - at + period), period)
            at = max(end, at) + 1
    return sorted((start, length, period) for (start, length), period in found.items())


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.integers(1, 160), st.sampled_from([(24, 3), (4, 2), (1, 2), (9, 4)]))
def test_runs_by_brute_force(seed, letters, size, rule):
    rng = random.Random(seed)
    ids = []
    while len(ids) < size:
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        ids += part * rng.choice([1, 1, 2, 4, 9])
    ids = ids[:size]
    _, small = np.unique(ids, return_inverse=True)
    assert periodic.runs_of(small, *rule) == by_hand(ids, *rule)


def test_run_just_long_enough():
    """Its repeat is shorter than the next power of two."""
    for least, periods in ((9, 4), (24, 3), (20, 2), (5, 5)):
        for period in range(1, least // periods + 1):
            ids = np.array([50, *[at % period for at in range(least)], 51, *range(60, 90)])
            _, small = np.unique(ids, return_inverse=True)
            assert periodic.runs_of(small, least, periods) == [(1, least, period)]


def test_suffixes_and_prefixes():
    rng = random.Random(5)
    for size in (1, 2, 3, 40, 200):
        ids = [rng.randrange(2) for _ in range(size)]
        _, small = np.unique(ids, return_inverse=True)
        order = periodic.suffixes(small, 1)
        wanted = sorted(range(size), key=lambda at: ids[at:])
        if order is None:  # no word repeats
            assert len(set(ids)) == size
            continue
        assert order.tolist() == wanted
        shared = periodic.common_prefixes(small.tolist(), wanted)
        for at in range(1, size):
            one, other = ids[wanted[at - 1] :], ids[wanted[at] :]
            same = next((k for k, (a, b) in enumerate(zip(one, other, strict=False)) if a != b), min(len(one), len(other)))
            assert shared[at] == same


@pytest.mark.parametrize("kind", ["one word", "two words", "random", "passages", "tails"])
def test_long_texts(kind):
    rng = random.Random(2)
    size = 60_000
    ids = {
        "one word": [0] * size,
        "two words": [0, 1] * (size // 2),
        "random": [rng.randrange(9000) for _ in range(size)],
        # Every copy of a passage has a word of its own before it, so as many classes as copies.
        "passages": [x for at in range(size // 51) for x in (100 + at, *range(50))],
        "tails": [x for at in range(size // 31) for x in (100 + at, *[7] * 30)],
    }[kind]
    _, small = np.unique(ids, return_inverse=True)
    begun = time.perf_counter()
    found = periodic.runs_of(small)
    assert time.perf_counter() - begun < 20
    wanted = {"one word": [(0, size, 1)], "two words": [(0, size, 2)], "random": [], "passages": []}
    assert found == wanted.get(kind, [(31 * at + 1, 30, 1) for at in range(size // 31)])


def digest(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    mixed = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    group, size = mixed // 10, len(words)
    if mixed % 10 == 0 and size:
        start = group % size
        period = 1 + (size - start) // (3 + group % 8)
        words = words[:start] + [words[start + (at - start) % period] for at in range(start, size)]
    found = by_hand(words)
    best = max(found, key=lambda run: (run[1] / run[2], -run[0], -run[2]), default=(None,) * 3)
    gone = {at for start, length, period in found for at in range(start + period, start + length)}
    kept = b" ".join(word for at, word in enumerate(words) if at not in gone)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_digest_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(None, "a b " * 20), (None, None), (1, ""), (2, " \t\n"), (3, None), (4, "x " * 24), (4, "x " * 24), (5, "x " * 23),
            (6, "é\xa0ü " * 30 + "\x0b z"), (7, "A a " * 12), (8, "one")]
    for doc_id in range(10, 150):
        words = [rng.choice("abcdefgh") + rng.choice(["", "é", ","]) for _ in range(rng.randint(1, 120))]
        rows.append((doc_id, rng.choice([" ", "\n", "  "]).join(words)))
    assert sum(zlib.crc32(str(row[0]).encode()) % 10 == 0 for row in rows) > 8
    frame = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, n_words string")
    found = periodic.run_digest(frame)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((digest(*row) for row in rows), key=repr)


def test_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a b a b", "k", 7)], "doc_id long, text string, runs string, best int")
    (row,) = periodic.periodic_runs(frame, least=4, periods=2).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a b a b", "best": 7, "n_words": 4, "runs": [(0, 4, 2)], "collapsed": "a b"}
    assert periodic.periodic_runs(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame, periods=1)


def test_query_by_brute_force(spark, tables):
    """The shorter documents of the table, and the hashes of all others by the plainer rule."""
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    found = {row.doc_id: tuple(row) for row in QUERIES["op11_periodic_runs"](spark, tables).collect()}
    assert len(found) == len(rows)
    short = [row for row in rows if len(row.text.split()) < 1500]
    assert len(short) > 100
    for row in short:
        assert found[row.doc_id] == digest(*row)
