import random

import pytest

from newsweave.llm.graph import components


def smallest(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    links = {
        "chain": [(i, i + 1) for i in range(60)] + [(100, 99)],
        "star": [(500, i) for i in range(300)],
        "random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)],
        "none": [],
    }[shape]
    shuffled = [rng.choice([(a, b), (b, a)]) for a, b in links] * 2
    frame = spark.createDataFrame([*shuffled, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == smallest([(a, b) for a, b in links if a != b])
