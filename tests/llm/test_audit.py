"""The audit of a shard's beams against brute force."""

import numpy as np
import pandas as pd
import pytest

from newsweave.llm import small_worlds
from newsweave.llm.small_worlds import BEAM, WHOLE, Graph


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def truth(queries, vectors, least):
    return [set(np.flatnonzero(row).tolist()) for row in queries @ vectors.T >= least]


@pytest.fixture(scope="module")
def points():
    """A dense group of 600, and 40 pairs among points without links."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((3000, 32))
    rows[:600] = rows[0] + 0.05 * rng.standard_normal((600, 32))
    rows[2960:] = rows[2000:2040] + 0.05 * rng.standard_normal((40, 32))
    return unit(rows)


def without_pairs(self, queries, least, beam):
    """Beams that lose the links of all but the dense group, until they are the whole shard."""
    if beam > WHOLE * len(self.vectors):
        return [np.flatnonzero(row) for row in queries @ self.vectors.T >= least]
    every = [np.flatnonzero(row) for row in queries @ self.vectors.T >= least]
    return [own if len(own) > BEAM else own[:0] for own in every]


@pytest.mark.parametrize("part", [slice(0, 3000), slice(600, 3000), slice(2000, 2960)])
def test_lost_pairs_are_seen(points, part, monkeypatch):
    """Neither a dense group nor a want of links lets a beam pass that finds no pair."""
    graph = Graph(points, [])
    monkeypatch.setattr(Graph, "within", without_pairs)
    found = graph.audited(points[part], 0.9, np.arange(3000)[part])
    assert [set(own.tolist()) for own in found] == truth(points[part], points, 0.9)


def counted(monkeypatch):
    """How many queries were compared whole since."""
    real, asked = Graph.whole, []
    monkeypatch.setattr(Graph, "whole", lambda self, queries, least: asked.append(len(queries)) or real(self, queries, least))
    return asked


def test_recall_of_beams(points, monkeypatch):
    graph = Graph.build(points)
    graph.settle(0.9)
    asked = counted(monkeypatch)
    found = graph.audited(points, 0.9, np.arange(3000))
    true = truth(points, points, 0.9)
    assert sum(set(own.tolist()) == t for own, t in zip(found, true, strict=True)) >= 0.99 * len(points)
    # Those audited and the dense group alone.
    assert sum(asked) <= small_worlds.AUDITED + 2 * 600


def test_rare_links_are_found_by_beams(monkeypatch):
    """Where hardly any vector has a link, all but those audited are answered by a beam."""
    rng = np.random.default_rng(8)
    rows = unit(rng.standard_normal((6000, 32)))
    aside = unit(rng.standard_normal((100, 32)))
    rows[5900:] = unit(rows[:100] + 0.45 * aside)
    graph = Graph.build(rows)
    graph.settle(0.9)
    asked = counted(monkeypatch)
    found = graph.audited(rows, 0.9, np.arange(6000))
    true = truth(rows, rows, 0.9)
    links = sum(len(t) - 1 for t in true)
    assert links >= 60
    assert sum(len(set(own.tolist()) & t) - 1 for own, t in zip(found, true, strict=True)) >= 0.95 * links
    assert sum(asked) <= small_worlds.AUDITED


def block(ids, vectors):
    return pd.DataFrame(
        [(3, np.int64(ids).tobytes(), np.ones(len(ids), np.int64).tobytes(), np.float64(vectors).tobytes())],
        columns=["at", "ids", "weights", "vectors"],
    )


def test_dense_group_tells_few(points):
    """A query of a dense group is counted whole and tells only points that few have found."""
    ids = np.arange(3000) * 10
    shard = small_worlds.build_shard(block(ids, points), 0.9)
    found = small_worlds.find_links(shard, block(ids, points), 0.9).set_index("id")
    true = truth(points, points, 0.9)
    dense = [i for i in range(600) if len(true[i]) > 300]
    assert len(dense) > 300
    for i in dense:
        row = found.loc[i * 10]
        assert row.whole and row.n == len(true[i]) - 1
        assert all(len(true[other // 10]) <= 2 * small_worlds.MANY for other in row.others)
    for i in range(2960, 3000):
        row = found.loc[i * 10]
        assert not row.whole and row.told == [True] * len(row.others)
        assert {other // 10 for other in row.others} == true[i] - {i}


def test_links_count_for_both_ends(spark):
    """A link that one end found counts for both, once, and no end that is exact counts it twice."""
    places = spark.createDataFrame([(2, 0, 1, 0, 1)], "length int, shard int, shards int, part int, parts int")
    rows = [
        # 1 and 2 found each other; 3 found 1 alone; 4 is exact and tells 5, which found nothing.
        (1, 1, 2, 0, False, 2, 1, [2], [2], [True]),
        (2, 2, 2, 0, False, 1, 1, [1], [1], [True]),
        (3, 5, 2, 0, False, 1, 1, [1], [1], [True]),
        (4, 1, 2, 0, True, 70, 4, [5, 6], [1, 1], [True, True]),
        (6, 1, 2, 0, True, 60, 4, [4], [1], [True]),
    ]
    found = spark.createDataFrame(rows, small_worlds.FOUND)
    got = {r.id: r.n for r in small_worlds.link_counts(found, places).collect()}
    assert got == {1: 2 + 5, 2: 1, 3: 1, 4: 70, 5: 1, 6: 60}
    assert small_worlds.link_counts(found.limit(0), places).collect() == []
