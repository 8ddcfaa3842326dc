"""Connected components against a union-find."""

import random

import pytest

from attestor.llm.components import components


def least_reachable(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((x, root(x)) for x in parent)


CHANCE = random.Random(5)
PATH = list(range(40))
CHANCE.shuffle(PATH)


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(3, 3), (None, 1), (2, None)],
        [(1, 2), (2, 1), (1, 2)],
        [(1, 3), (2, 3)],  # two centres share an end
        [(1, 2), (2, 3)],  # an end that is a centre
        [(9, k) for k in range(9)],
        list(zip(PATH, PATH[1:], strict=False)),
        [(CHANCE.randrange(120), CHANCE.randrange(120)) for _ in range(90)],
    ],
)
def test_components_are_those_of_a_union_find(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted((r["node"], r["component"]) for r in found.collect()) == least_reachable(links)
