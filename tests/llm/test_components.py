"""Components against a union-find, at once and link by link."""

import random

import pytest

from tidemark.llm.components import components, merged


def _brute(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    path = [(k, k + 1) for k in range(-900, -870)]
    star = [(5000, 5000 + k) for k in range(1, 40)]
    links = path + star + [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    links = [x for x in links if x[0] != x[1]]
    rnd.shuffle(links)
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    found = components(frame(links + links[:5]))
    assert {r.node: r.comp for r in found.collect()} == _brute(links) and found.count() == len(_brute(links))
    half = len(links) // 2
    more = merged(components(frame(links[:half])), frame(links[half:]))
    assert {r.node: r.comp for r in more.collect()} == _brute(links) and more.count() == len(_brute(links))


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0 and merged(components(none), none).count() == 0
