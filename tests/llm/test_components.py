import random

import pytest

from bazarlens.llm.components import connected_components


def plain_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("few_links", [0, 60, 1 << 20])
def test_chain_star_and_random_links(spark, few_links):
    random.seed(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(random.randint(200, 400), random.randint(200, 400)) for _ in range(120)]
    pairs = [p for p in pairs if p[0] != p[1]]
    frame = spark.createDataFrame(pairs + pairs[:5] + [(None, 3), (7, None), (900, 900)], "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(frame, few_links).collect()} == plain_components(pairs)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
