"""Operator 13 against a plain tree, with small blocks so that several rounds are needed."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, n long, digest string, way string"


def _rows():
    rnd = random.Random(4)
    langs = [None, "", "de", "en", "en", "en", "é", "zh", "=", "-"]
    out = [(k, rnd.choice(["x", "", None, "é" * 5, "long " * 9000]), rnd.choice(langs), rnd.choice(["s", None, "3:abc"]), rnd.choice([None, 4, -7]), "t", 1, 2, "d", "w") for k in rnd.sample(range(1000), 150)]
    return out + [(None, "a", "en", "s", 1, "t", 1, 2, "d", "w"), (None, "b", "en", "s", 1, "t", 1, 2, "d", "w"), out[3], out[3], (7777, "alone", "only", "s", 5, None, None, None, None, None)]


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf(r, more=0):
    fields = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def _steps(levels, k):
    for level in levels[:-1]:
        run = level[k - k % 2 : k - k % 2 + 2]
        yield k % 2, run
        k //= 2


def _plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: _levels([_leaf(r) for r in sorted(trees[x], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))]) for x in order}
    top = _levels([levels[x][-1][0] for x in order])
    out = []
    for at, x in enumerate(order):
        for k, r in enumerate(sorted(trees[x], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            d, siblings = _leaf(r, bad), ""
            for side, run in [*_steps(levels[x], k), *_steps(top, at)]:
                siblings += "".join(run[:side] + run[side + 1 :])
                d = _h("".join([*run[:side], d, *run[side + 1 :]]))
            out.append((r[0], _leaf(r), levels[x][-1][0], top[-1][0], _h(siblings), d, d == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest(spark, bits):
    rows = _rows()
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.merkle_manifest(spark.createDataFrame(rows, KIND).repartition(3), tampers, bits)
    want = _plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[6] for r in want} == {True, False}


def test_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert merkle.merkle_manifest(empty).count() == 0
    one = spark.createDataFrame([(1, "t", None, None, None, *[None] * 5)], KIND)
    (r,) = merkle.merkle_manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == _h("")
    same = spark.createDataFrame([(k, None, f"l{k}", None, None, *[None] * 5) for k in range(5)], KIND)
    rows = merkle.merkle_manifest(same, bits=1).collect()
    assert all(r.verified and r.leaf == r.subroot for r in rows) and len({r.root for r in rows}) == 1


def test_rows_are_numbered_over_tasks(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k % 50) for k in range(1000)], "tree string, k long").repartition(7)
    rows = merkle.numbered(df, "tree", ["k"]).collect()
    for tree in "ab":
        own = sorted((r.at, r.k, r.n) for r in rows if r.tree == tree)
        assert [x[0] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}
        assert [x[1] for x in own] == sorted(x[1] for x in own)


def test_heap_and_levels():
    digests = [_h(str(k)) for k in range(11)]
    nodes = merkle.rise(digests, merkle.levels_of(11, 12))
    assert nodes == _levels(digests)
    for k, way in enumerate(merkle.fall(nodes, "")):
        assert merkle.fold(digests[k], way)[0] == nodes[-1][0]
    # a block of a larger tree goes on to its last level, though one node is left
    assert [len(x) for x in merkle.rise(digests[:3], 4)] == [3, 2, 1, 1, 1]
