import random

import pytest

from voicelane.llm import common


def brute(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def shapes():
    rng = random.Random(3)
    yield [(i, i + 1) for i in range(150)]  # a path
    yield [(i, 1_000) for i in range(200)]  # a star whose centre is the largest
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    yield [(5, 5), (7, 7)]
    yield []


@pytest.mark.parametrize("edges", list(shapes()))
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    found = {r["node"]: r["root"] for r in common.components(frame).collect()}
    assert found == {n: r for n, r in brute([e for e in edges if e[0] != e[1]]).items() if n != r}
