"""Star contraction against a plain union-find."""

import random

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components


def test_components_against_union_find(spark):
    """A long path in shuffled order, a node with many neighbours, random edges, loops and repeated edges."""
    rng = random.Random(4)
    path = list(range(1000, 1040))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(-7, n) for n in range(2000, 2300)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += edges[:5] + [(5000, 5000)]
    up = {n: n for e in edges for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()
    got = {r["node"]: r["root"] for r in rows}
    joined = {n for a, b in edges if a != b for n in (a, b)}
    assert len(rows) == len(got) and got == {n: find(n) for n in joined}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0
