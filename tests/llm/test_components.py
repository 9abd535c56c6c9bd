"""Components against a plain union of sets."""

import random

import pytest

from plectra.llm.components import connected_components


def plain(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(2, 1), (3, 1), (5, 4)],
        [(k, k + 1) for k in range(20)],
        [(0, k) for k in range(1, 30)] + [(30, 29), (31, 30)],
        random.Random(1).choices([(a, b) for a in range(40) for b in range(40) if a != b and a % 4 == b % 4], k=60),
    ],
)
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.root for r in got} == plain(edges)
