"""The pipeline's stages one after another."""

import collections
import glob
import hashlib
import re

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix
from tidemark.llm.quality_rules import DecisionList
from tidemark.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert docs.columns == columns
        ids = [r.doc_id for r in rows]
        assert set(ids) <= set(kept) and len(ids) == len(set(ids))
        kept = ids
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text) for r in rows]
    assert len(texts) == len(set(texts))
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(kept)
    out = corpus_pipeline.encode(spark, mixed, SF)
    assert out.count() == mixed.count()


def test_files_of_the_mixing_stage_follow_the_curriculum(spark, tmp_path):
    texts = [" ".join(f"w{k}x{j}" for j in range(3 + k * 7 % 11)) for k in range(150)] + ["", None]
    rows = [(k, t, "en", "abc"[0 if k < 20 else k % 3]) for k, t in enumerate(texts)] + [(None, "no id here", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = []
    whole = {s: 0 for s in "abc"}
    mixed = sorted(mix(docs).collect(), key=lambda r: (r.source, r.first_time is None, r.first_time))
    for r in mixed:
        # words of a source before a document, in the order in which it is read
        begin, whole[r.source] = whole[r.source], whole[r.source] + r.size
        slope, words = 0.5 if r.source in "ac" else -0.5, int(r.target + 0.5)
        for k in range(r.copies):
            done, low, high = min(1, (k * r.source_size + begin) / words), 0.0, 1.0
            for _ in range(60):
                t = (low + high) / 2
                low, high = (t, high) if (1 - slope) * t + slope * t * t < done else (low, t)
            if r.size:
                want.append((high, r.doc_id))
    assert any(r.copies > 1 for r in mixed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mixed(spark, docs, SF).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(str(tmp_path / "out/part-*.parquet")))
    assert len(files) > 1
    got = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert list(got[0]) == docs.columns
    time_of = {}
    for t, i in want:
        time_of.setdefault(i, []).append(t)
    times = {i: iter(sorted(ts)) for i, ts in time_of.items()}
    # copies of a document come in order of their times, so the stream's times never fall
    stream = [next(times[r["doc_id"]]) for r in got if r["text"]]
    assert len(stream) == len(want) and stream == pytest.approx(sorted(stream), abs=1e-9)


WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = [" ".join(f"{c}{k}" for k in range(70)) for c in "abcdef"]


def _awkward():
    rows = [(5, PROSE[0]), (3, PROSE[0].replace(" ", "  ")), (None, PROSE[0]), (9, PROSE[0].replace("a30", "zz")), (3, PROSE[1]), (3, PROSE[1]), (None, PROSE[2]), (None, PROSE[2])]
    rows += [(None, PROSE[3]), (None, PROSE[3] + " end"), (7, None), (8, ""), (2, "too short"), (4, "again and again " * 30), (6, PROSE[4] + " tail"), (1, PROSE[4])]
    return [(i, t, "en", "ab"[k % 2], k, "x", "y") for k, (i, t) in enumerate(rows)]


KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, _key string"


def _plain_near(rows):
    """One row of each class: sets of five words, 0.8 or more."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (WORD.findall(r[1].lower()) for r in rows)]
    left, out = set(range(len(rows))), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
            left -= near
            todo += near
        key = lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5(rows[k][1].encode()).digest())
        out.append(rows[min(group, key=key)])
    return out


def test_stages_agree_with_a_plain_version_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "fit_rules", lambda *_: DecisionList([]))
    docs = spark.createDataFrame(_awkward(), KIND).repartition(3)
    good = corpus_pipeline.quality(spark, docs, SF)
    repeats = lambda w: len({k + j for k in range(len(w) - 2) for j in range(3) if sum(w[m : m + 3] == w[k : k + 3] for m in range(len(w) - 2)) > 1})
    want = [r for r in _awkward() if len(w := WORD.findall(r[1] or "")) >= 50 and 100 * repeats(w) <= 50 * len(w)]
    assert sorted(map(tuple, good.collect()), key=str) == sorted(want, key=str) and good.columns == docs.columns
    one = corpus_pipeline.exact(spark, good, SF)
    groups = collections.defaultdict(list)
    for r in want:
        groups[re.sub("[\x20\x09-\x0d]+", " ", r[1])].append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    got = one.collect()
    assert sorted((str(r.doc_id), WORD.findall(r.text)) for r in got) == sorted((str(r[0]), WORD.findall(r[1])) for r in want) and one.columns == docs.columns
    near = corpus_pipeline.near(spark, one, SF)
    left = _plain_near([tuple(r) for r in got])
    assert sorted(map(tuple, near.collect()), key=str) == sorted(left, key=str) and near.columns == docs.columns
    stream = corpus_pipeline.mixed(spark, near, SF)
    copies = collections.Counter()
    for r in mix(near).collect():
        copies[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in stream.collect()) == +copies and stream.columns == docs.columns
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = collections.Counter(hashlib.sha256(",".join(map(str, lib.encode(r.text))).encode()).hexdigest() for r in stream.collect())
    assert collections.Counter(r.ids_sha256 for r in corpus_pipeline.encode(spark, stream, SF).collect()) == texts


def test_stages_on_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "fit_rules", lambda *_: DecisionList([]))
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert corpus_pipeline.encode(spark, docs, SF).count() == 0
