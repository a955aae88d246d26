"""Operators 8, 9 and 10 and the pipeline's stages row by row against plain versions."""

import collections
import math
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixing, quality_rules
from tidemark.llm.queries import QUERIES
from tidemark.llm.words import mixed

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _plain_targets(sizes, cycle=(3, 1, 2), budget=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    left, full = budget * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] >= cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        for s in over:
            full.add(s)
            left -= cap * sizes[s]


def _plain_taken(rows, target):
    """Words that a source's reading takes from each of its rows (size, key, id), in the order of the reading."""
    size, words = sum(r[0] for r in rows), int(target + 0.5)
    rounds, left = (words // size, words % size) if size else (0, 0)
    begin, out = 0, []
    for n, key, i in rows:
        out.append((i, rounds * n + max(0, min(n, left - begin))))
        begin += n
    return out


def test_mixing_takes_what_a_plain_reading_takes(spark):
    texts = [" ".join(f"w{j}" for j in range(1 + k * 13 % 37)) for k in range(300)] + ["", None]
    rows = [(k, t, ["a", None, "b", "c", "d"][0 if k % 3 else k % 5]) for k, t in enumerate(texts)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), blocks=7).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = _plain_targets(sizes)
    for s in sizes:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.key % 7, r.key, r.doc_id))
        assert {round(r.target, 6) for r in mine} == {round(targets[s], 6)} and {r.source_size for r in mine} == {sizes[s]}
        assert [(r.doc_id, r.taken) for r in mine] == _plain_taken([(r.size, r.key, r.doc_id) for r in mine], targets[s])


def _plain_vector(text, model):
    low = [int(language_id._LOWER[b]) for b in (text or "").encode()]
    counts = np.zeros(language_id.BUCKETS)
    for k in language_id.SIZES:
        for i in range(len(low) - k + 1):
            gram = 0
            for b in low[i : i + k]:
                gram = gram << 8 | b
            at = int(mixed(np.array([gram + (k << 32)], np.uint64))[0]) >> (64 - language_id.BUCKETS.bit_length() + 1)
            counts[at] += 1
    x = np.log1p(counts) * model.idf
    return x / max(math.sqrt((x * x).sum()), 1e-9)


def test_language_scores_agree_with_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit_centroids(docs)
    some = docs.filter("doc_id % 9 = 0 and n_chars < 3000").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !?"), (-4, "der die das und nicht"), (-5, "é")], "doc_id long, text string")
    rows = some.unionByName(odd)
    for r in rows.select("doc_id", "text", language_id.language_of(docs, model, F.col("text")).alias("l")).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.l.lang_pred, r.l.score, r.l.rejected) == ("und", 0.0, True)
            continue
        close = model.centre.astype(float) @ _plain_vector(r.text, model)
        assert r.l.score == pytest.approx(min(1, max(0, close.max())), abs=1e-4)
        near = {model.langs[model.of[k]] for k in np.flatnonzero(close > close.max() - 1e-5)}
        assert r.l.lang_pred in near


def test_repeated_ids_teach_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs
    for _ in range(3):
        more = more.unionByName(docs)
    a, b = language_id.fit_centroids(docs), language_id.fit_centroids(more)
    assert np.array_equal(a.centre, b.centre) and np.array_equal(a.idf, b.idf)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality_rules.fit_rules(docs, labels).rules == quality_rules.fit_rules(more, labels).rules


def _features(r):
    n, chars, lines = max(r.n_words, 1), max(r.word_chars, 1), max(r.n_lines, 1)
    values = (r.n_words, r.word_chars / n, r.n_symbols / n, r.n_dup_lines / lines, r.n_repeat_words / n, r.n_upper / chars, r.n_digits / chars, r.n_distinct / n, r.n_marks / n, r.n_words / lines)
    return dict(zip(quality_rules.FEATURES, values, strict=True))


def _plain_kept(stats, rules):
    if stats.n_words < 50 or 100 * stats.n_repeat_words > 50 * stats.n_words:
        return False
    f = _features(stats)
    for conditions, reject in rules.rules:
        if all(f[name] >= bound if side == ">=" else f[name] < bound for name, side, bound in conditions):
            return not reject
    return True


@pytest.fixture(scope="module")
def rules(spark):
    d = "/root/testdata/sf0.01"
    out = quality_rules.fit_rules(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert out.rules
    return out


def test_learned_rules_decide_as_a_plain_list(spark, rules):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ordered = quality_rules.DecisionList([([("n_words", ">=", 400.0)], False), *rules.rules, ([("n_words", "<", 60.0)], True)])
    for list_ in (rules, ordered):
        got = quality_rules.judged(docs.select("doc_id", "text"), list_).collect()
        assert [r._kept for r in got] == [_plain_kept(r._stats, list_) for r in got]
        assert len({r._kept for r in got if not r._base_failed}) == 2


def test_quality_stage_keeps_what_the_plain_list_keeps(spark, rules, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "fit_rules", lambda *_: rules)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumns({"_kept": F.lit("mine"), "_stats": F.col("doc_id") * 2, "_base_failed": F.lit(None).cast("int"), "row": F.lit("r")})
    want = {r.doc_id for r in quality_rules.judged(docs.select("doc_id", "text"), rules).collect() if _plain_kept(r._stats, rules)}
    out = corpus_pipeline.quality(spark, docs, SF)
    rows = out.collect()
    assert out.columns == docs.columns and {r.doc_id for r in rows} == want and len(rows) == len(want)
    assert all(r._kept == "mine" and r._stats == 2 * r.doc_id and r._base_failed is None and r.row == "r" for r in rows)


def test_mixing_stage_repeats_what_a_plain_reading_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    want = collections.Counter()
    for s in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (r.key % mixing.BLOCKS, r.key, r.doc_id))
        sizes = [(r.size, r.key, r.doc_id) for r in mine]
        for (n, _, i), (_, taken) in zip(sizes, _plain_taken(sizes, mine[0].target), strict=True):
            want[i] += int(taken / n + 0.5) if n else int(mine[0].target >= 0.5)
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).select("doc_id").collect())
    assert got == +want


def test_registered_languages_are_learned_ones(spark):
    got = QUERIES["op9_language_id"](spark, SF).select("lang_pred").distinct().collect()
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
