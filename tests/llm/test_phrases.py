"""Operator 12 against a plain version, with collisions forced."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases
from tidemark.llm.words import slices

KIND = "doc_id long, text string, lang string, phrase string, n int, word string, a int"


def _rows():
    rnd = random.Random(2)
    out = []
    for k in range(120):
        words = [rnd.choice(["the", "The", "sea", "é", "日本", "of", "x" * 70, "y", "z"]) for _ in range(rnd.randrange(60))]
        text = "".join(w + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        out.append((k, text + " new york city new york city hall", [None, "en", "en", "de", "und"][k % 5], "p", 1, "w", 2))
    long = " ".join(rnd.choice("abcdefg") for _ in range(40_000))
    return out + [(900, None, "en", None, None, None, None), (901, "", "de", None, None, None, None), (902, " \n.", None, None, None, None, None), (903, long, "fr", None, None, None, None), (None, "new york new york", "fr", None, None, None, None), (5, out[5][1], out[5][2], "p", 1, "w", 2)]


def _plain(rows, least, longest, share, top):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in some.items():
            if inside[p] and 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def _got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("least", "longest", "share", "top"), [(5, 5, 100, 2000), (3, 3, 60, 7), (2, 2, 100, 50)])
def test_collocations(spark, least, longest, share, top):
    rows = _rows()
    got = phrases.collocations(spark.createDataFrame(rows, KIND).repartition(3), least, longest, share, top)
    want = _plain(rows, least, longest, share, top)
    assert _got(got) == want and len(want) > 20
    assert phrases.collocations(spark.createDataFrame([], KIND)).count() == 0


def test_pointers_lead_to_the_phrase(spark):
    rows = {r[0]: r for r in _rows()}
    for r in phrases.collocations(spark.createDataFrame(_rows(), KIND), 5).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), rows[r.first_doc_id][1])
        assert re.split("[\x20\x09.,;:!?\x0a-\x0d]+", low)[r.first_word :][: r.phrase.count(" ") + 1] == r.phrase.split(" ")


def test_counts_are_exact_when_fingerprints_collide(spark, monkeypatch):
    real = phrases.Grams.of

    def of(self, size):
        first, fp = real(self, size)
        return first, fp & np.uint64(7 << 61)

    rows = _rows()[:40]
    monkeypatch.setattr(phrases.Grams, "of", of)
    import pyarrow as pa

    langs = pa.array([r[2] for r in rows], pa.string())
    batch = pa.RecordBatch.from_arrays([langs, pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], names=["lang", "text", "doc_id"])
    got = Counter()
    for b in phrases._texts((2, 3), None)([batch]):
        for lang, phrase, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            got[lang, phrase] += n
    want = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.lower()):
            w = re.findall("[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(w[i : i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
    assert got == want


def test_fingerprints_do_not_depend_on_where_words_stand():
    import pyarrow as pa

    (text,) = slices(pa.array(["a bb ccc", "zz a  bb\tccc. a bb, ccc", "bb ccc"]))
    grams = phrases.Grams(text, np.zeros(3, np.uint64))
    first, fp = grams.of(3)
    assert len(first) == 3 and fp[0] == fp[2] != fp[1]
    first, fp = grams.of(2)
    assert len(set(fp.tolist())) == 3 and len(first) == 7


def test_scores_pass_64_bits(spark):
    a, n, l, r = 3 * 10**13, 9 * 10**14, 7 * 10**13, 11
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    from pyspark.sql import functions as F

    df = df.select(phrases._product(F.lit(1000), F.col("a"), F.col("n")).alias("x"), phrases._product(F.col("l"), F.col("r")).alias("y"))
    assert df.select(F.expr("x div y").alias("s")).first().s == 1000 * a * n // (l * r)
