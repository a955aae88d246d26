"""Operator 11 against a plain version, and the code behind its keys."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, fp long, key string, comp string, copies int"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = " ".join(f"w{k}" for k in range(60))


def _rows():
    long = " ".join(random.Random(3).choice("abcdefgh") * 3 + str(k % 997) for k in range(60_000))
    texts = [BASE, BASE.upper(), BASE.replace("w30", "zz"), None, "", " \n", "one two", "One\ttwo", "é ½ 🤣 日本\nx\ty", long, long + " tail", "a " * 9, "x" * 90_000]
    return [(k + 1, t, 7, "k", "c", k) for k, t in enumerate(texts)] + [(3, texts[2], 1, "k", "c", 0), (None, BASE, None, None, None, None), (None, "no id at all here", None, None, None, None)]


def _print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain(ids, prints):
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    some = sorted(up)
    for k, a in enumerate(some):
        for b in some[:k]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    low = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            low[root(p)] = min(i, low.get(root(p), i))
    return sorted(((i, f"{p:016x}", low.get(root(p))) for i, p in zip(ids, prints, strict=True)), key=str)


def test_awkward_rows_agree_with_a_plain_version(spark):
    rows = _rows()
    got = simhash.simhash_classes(spark.createDataFrame(rows, KIND).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id", "copies"]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == _plain([r[0] for r in rows], [_print(r[1]) for r in rows])
    assert simhash.simhash_classes(spark.createDataFrame([], KIND)).count() == 0


def test_query_agrees_with_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_simhash_near_dedup"](spark, SF).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == _plain([r.doc_id for r in docs], [_print(r.text) for r in docs])


def test_codewords_within_four_bits():
    rnd = np.random.default_rng(0)
    some = rnd.integers(0, 1 << 23, 20_000)
    near = simhash.codewords(some)
    own = near[:, 0] << 11 | simhash.REST[near[:, 0]]
    assert np.bitwise_count(own ^ some).max() == 3 and np.all(np.isin((near >= 0).sum(axis=1), (1, 6)))
    other = some ^ (1 << rnd.integers(0, 23, len(some)))
    assert np.all((simhash.codewords(other) == near[:, :1]).any(axis=1))
    words = np.arange(4096) << 11 | simhash.REST
    assert np.bitwise_count(words[:, None] ^ words[None, :500])[~np.eye(4096, 500, dtype=bool)].min() == 7


def test_any_three_bits_share_a_key():
    rnd = random.Random(5)
    for n in range(4):
        a = np.array([rnd.getrandbits(64) for _ in range(4000)], np.uint64)
        b = a ^ np.array([sum(1 << x for x in rnd.sample(range(64), n)) for _ in a], np.uint64)
        met = np.zeros(len(a), bool)
        for (home, _), (own, more) in zip(simhash.keys(a), simhash.keys(b), strict=True):
            met |= (home == own) | (more == home[:, None]).any(axis=1)
        assert met.all()


@pytest.mark.parametrize("block", [4, 8192])
def test_dense_groups_are_linked_whole(spark, block):
    rnd = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(80):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5])))
            prints.add(x)
            prints.update(x ^ 1 << b for b in range(3))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.hamming_links(df, block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    for k, a in enumerate(prints):
        for b in prints[:k]:
            assert (a ^ b).bit_count() > 3 or root(a) == root(b)


def test_forest_has_one_link_fewer_than_members():
    a, b = simhash.forest(np.array([0, 1, 3, 7, 255, 254, 1 << 40], np.uint64))
    assert len(a) == 5 and np.bitwise_count(a ^ b).max() <= 3


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame(_rows(), KIND)
    clash = df.withColumn("low", F.lit("x")).withColumn("node", F.lit(1)).withColumn("component_id", F.lit(9))
    assert sorted(map(str, simhash.simhash_classes(clash).collect())) == sorted(map(str, simhash.simhash_classes(df).collect()))
