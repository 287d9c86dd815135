"""Overlapping regions of vectors: near ones share one, and a link counts once."""

import numpy as np
import pandas as pd
import pytest

from newsweave.llm import regions, small_worlds, vectors
from tests.llm.test_vectors import ODD, SCHEMA, expected_links, rows_of


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def drawn(kind, rng, count=2048):
    if kind == "even":
        return unit(rng.standard_normal((count, 32)))
    if kind == "cone":
        return unit(rng.standard_normal((count, 32)) + 1)
    return unit(rng.standard_normal((20, 32))[rng.integers(0, 20, count)] + 0.5 * rng.standard_normal((count, 32)))


@pytest.mark.parametrize("kind", ["even", "cone", "groups"])
def test_a_vector_meets_few_of_many(kind):
    """A hundred times the vectors: near ones still share a region, and a vector meets far less than a hundred times as many."""
    rng = np.random.default_rng(4)
    own = drawn(kind, rng)
    few, many = regions.learn(own, 40_000, 0.9), regions.learn(own, 4_000_000, 0.9)
    # Vectors met, if regions are alike.
    assert 4_000_000 * many.reach**2 / len(many.pivots) <= 32 * 40_000 * few.reach**2 / len(few.pivots)
    fresh = drawn(kind, rng)
    for towards in (rng.standard_normal(fresh.shape), np.roll(fresh, 1, axis=0)):
        near = regions.planted(fresh, towards, 0.9)
        assert np.allclose(np.einsum("nd,nd->n", fresh, near), 0.9)
        assert (few.of(fresh)[:, :, None] == few.of(near)[:, None, :]).any(axis=(1, 2)).mean() >= 0.99


def test_no_regions_where_they_part_nothing():
    """Vectors that all lie within the least cosine of each other stay in one room."""
    rng = np.random.default_rng(6)
    assert regions.learn(unit(np.ones(32) + 0.05 * rng.standard_normal((500, 32))), 40_000, 0.5) is None


def of_regions(count=3000):
    """Half without links, a dense group, and pairs."""
    rng = np.random.default_rng(12)
    rows = rng.standard_normal((count, 32))
    rows[: count // 5] = rows[0] + 0.15 * rng.standard_normal((count // 5, 32))
    rows[count // 2 :] = rows[: count - count // 2] + 0.2 * rng.standard_normal((count - count // 2, 32))
    rows[7], rows[9] = 2 * rows[8], rows[8]
    return np.float32(rows)


@pytest.mark.parametrize(("shard", "region"), [(1000, 500), (300, 700)])
def test_links_by_regions(spark, monkeypatch, shard, region):
    """Each link counts once, whichever regions its ends share, and whether these are one shard or several."""
    monkeypatch.setattr(small_worlds, "SHARD_ROWS", shard)
    monkeypatch.setattr(vectors, "PART_ROWS", 250)
    monkeypatch.setattr(regions, "REGION_ROWS", region)
    found, real = [], small_worlds.draw_rooms
    monkeypatch.setattr(small_worlds, "draw_rooms", lambda *given: found.append(real(*given)) or found[0])
    rows = of_regions()
    frame = spark.createDataFrame(rows_of(rows) + ODD, SCHEMA)
    got = {r.vec_id: r for r in small_worlds.similar_vectors(frame).collect()}
    assert found[0][0].lengths[32][1].reach > 1
    links, label = expected_links(rows, 0.9)
    assert len(got) == len(rows) + len(ODD)
    assert sum(got[i].n_links for i in range(len(rows))) >= 0.998 * links.sum()
    assert all(0.95 * links[i] <= got[i].n_links <= links[i] for i in range(len(rows)) if links[i] >= 100)
    few = [i for i in range(len(rows)) if links[i] < 100]
    assert len(few) >= 1000 and sum(got[i].n_links == links[i] for i in few) >= 0.99 * len(few)
    assert [got[i].component_id for i in range(len(rows))] == label.tolist()


def test_long_answers_are_bits(monkeypatch):
    """A dense group's answers are held as bits, and say the same."""
    rows = unit(np.float64(of_regions()))
    ids = np.arange(len(rows))
    homes = np.sort(np.random.default_rng(2).permuted(np.tile(np.arange(5, dtype=np.int32), (len(rows), 1)), axis=1)[:, :3], axis=1)
    homes[:, 0] = np.minimum(homes[:, 0], 2)
    here = (homes == 2).any(axis=1)
    frame = pd.DataFrame(
        [(2, 2, ids[here].tobytes(), np.ones(here.sum(), np.int64).tobytes(), rows[here].tobytes(), homes[here].tobytes(), False)],
        columns=["room", "at", "ids", "weights", "vectors", "homes", "single"],
    )
    listed = small_worlds.solve_room(frame, 0.9).set_index("id")
    monkeypatch.setattr(small_worlds, "LISTED", 50)
    assert small_worlds.solve_room(frame, 0.9).set_index("id").equals(listed)
    # Those in a room before this one, too, count there.
    near = unit(rows[here]) @ unit(rows[here]).T >= 0.9
    before = [set(own[own < 2].tolist()) for own in homes[here]]
    for at in np.flatnonzero(listed.loc[ids[here], "whole"] if here.all() else np.isin(ids[here], listed.index[listed["whole"]])):
        others = [o for o in np.flatnonzero(near[at]).tolist() if o != at and not before[at] & before[o]]
        assert listed.loc[ids[here][at], "n"] == len(others)
