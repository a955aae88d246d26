"""Operators against brute force, exact round trips and held-out labels, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import backoff_lm, exact_dedup, language_id, mixing, ngram_jaccard, quality_rules, sentencepieces, sharding, token_counts, toxicity
from tidemark.llm.queries import QUERIES, tokenizer_file, tokenizer_pattern

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n int, node long, gram long"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = " ".join(f"w{k}" for k in range(60))


def _rows():
    long = " ".join(random.Random(3).choice("abcdefgh") * 3 + str(k % 997) for k in range(30_000))
    texts = [BASE, BASE, BASE.upper(), BASE.replace("w30", "zz"), BASE.replace("w30", "zz").replace("w5 ", "yy "), None, "", "  \n", "one two", "One  two", "é ½ 🤣 日本\nx\ty", long, long + " tail", "a a a a a a a a", "same\nsame\n\nsame"]
    return [(k, t, "en", ["b", None, "a"][k % 3], k, 1, 2) for k, t in enumerate(texts)] + [(3, texts[3], "en", "b", 0, 1, 2), (None, "no id here at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def _low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _shingles(t):
    w = WORD.findall(_low(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _classes(rows):
    sets = [_shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[root(k)].append(r[0])
    return sorted(((r[0], len(s), (min(low[root(k)]) if low[root(k)] else None) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_jaccard(docs, empty):
    got = ngram_jaccard.near_duplicate_classes(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == _classes(_rows())
    assert ngram_jaccard.near_duplicate_classes(empty).count() == 0


def test_jaccard_joins_a_large_group_of_near_copies(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(250):
        w = BASE.split()
        for j in rnd.sample(range(60), rnd.choice([0, 1, 1, 2])):
            w[j] = f"x{k}"
        rows.append((k, " ".join(w), "en", "a", 0, 0, 0))
    got = ngram_jaccard.near_duplicate_classes(spark.createDataFrame(rows, KIND))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == _classes(rows)


def test_jaccard_tells_large_classes_apart_that_meet(spark):
    # two classes of near copies that share a rare passage, and copies so far off that they are alone
    rnd = random.Random(4)
    shared = " ".join(f"s{k}" for k in range(14))
    rows = []
    for k in range(240):
        w = [f"{'pq'[k % 2]}{j}" for j in range(60)]
        for j in rnd.sample(range(60), rnd.choice([0, 1, 1, 2, 3, 4])):
            w[j] = f"x{k}y{j}"
        rows.append((k, " ".join(w) + " " + shared, "en", "a", 0, 0, 0))
    want = _classes(rows)
    assert len({c for *_, c in want}) > 20
    for block in (1 << 11, 16):
        got = ngram_jaccard.NgramJaccardJoin(spark.createDataFrame(rows, KIND), block=block).classes()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == want


def _morse():
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_differ_in_a_regular_way_are_told_apart(spark):
    a, b = _morse()
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(0, f"{a} {words}\n{b} {words}", "en", "a", 0, 0, 0), (1, " ".join([a] * 8), "en", "a", 0, 0, 0), (3, " ".join([b] * 8), "en", "a", 0, 0, 0)]
    df = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicate_classes(df).collect()}
    assert got == {0: 0, 1: 1, 3: 3}
    stats = {r.doc_id: r._stats for r in quality_rules.judged(df, quality_rules.DecisionList([])).collect()}
    assert stats[0].n_dup_lines == 0
    known = {r.doc_id: r.n_known for r in backoff_lm.score_documents(df.filter("doc_id <> 1"), chunk_bytes=50_000).collect()}
    assert known[3] == 9 if zlib.crc32(b"3") % 7 != 2 else True


def test_jaccard_names_connecting_links(spark):
    rows = [(k, BASE.replace("w30", f"x{k}"), "en", "a", 0, 0, 0) for k in range(12)]
    join = ngram_jaccard.NgramJaccardJoin(spark.createDataFrame(rows, KIND), 5, 80)
    got = join.classes().toPandas()
    assert "n_links" not in got.columns and not hasattr(join, "links")
    links = join.connecting_links().collect()
    assert len(rows) - 1 <= len(links) <= len(rows) * (len(rows) - 1) // 2
    assert got.n_connecting_links.sum() == 2 * len(links) and got.n_connecting_links.min() >= 1
    assert set(got.component_id) == {0}


def test_exact_dedup(docs, empty, spark):
    got = exact_dedup.exact_dedup(docs).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in _rows():
        groups[norm(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        want += [(i, low, len(ids), i == low, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0
    whole = exact_dedup.dedup_in_loads(docs, 3).collect()
    assert sorted((tuple(r)[:5] for r in whole), key=str) == sorted(want, key=str)
    assert exact_dedup.dedup_in_loads(empty).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = sorted(map(tuple, exact_dedup.exact_dedup(docs, index, "monday").collect()), key=str)
    some = docs.filter("doc_id < 5")
    again = exact_dedup.exact_dedup(some, index, "tuesday")
    assert again.filter("kept").count() == 0 and again.count() == some.count()
    # the first load, run again under its name, gives what it gave, before and after compaction
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, index, "monday").collect()), key=str) == first
    index.compact()
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, index, "monday").collect()), key=str) == first
    assert index.read().count() == len(groups)
    index.drop()


def test_index_decides_which_row_stays(docs, monkeypatch):
    """What a load has left in the index is what later ones and the result go by."""
    real = exact_dedup.DigestIndex._write

    def falsified(self, rows, table):
        real(self, rows.withColumn("keep_id", F.lit(-5).cast("long")), table)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_write", falsified)
    got = exact_dedup.dedup_in_loads(docs, 3).collect()
    assert {r.keep_id for r in got} == {-5} and not any(r.kept for r in got)


def test_token_counts_add_up(docs, empty):
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=token_counts.read_ranks(path), special_tokens={})
    got = token_counts.section_token_counts(docs, path, tokenizer_pattern())
    n = collections.Counter()
    for r in got.collect():
        n[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for r in _rows():
        want[r[0]] += len(enc.encode_ordinary(r[1] or ""))
    assert n == want
    assert token_counts.section_token_counts(empty, path, tokenizer_pattern()).count() == 0
    n, over = token_counts.attribute(np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 4]))
    assert n.tolist() == [2, 1] and over.tolist() == [1, 0]


def test_sharding(docs, empty):
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(names, 251)
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    fewer = sharding.fill_table(names[:-1], 251)
    assert (table != fewer).mean() < 2.5 / 7
    got = sharding.place(docs, names, slots=251).collect()
    for r in got:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:13], 16) % 251
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(empty, names).count() == 0
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 64)
    odd = docs.select("doc_id", F.lit(1).alias("_slot"), F.lit(2).alias("_shard"), F.lit(3).alias("row"), F.lit(4).alias("at"), F.lit(5).alias("slot"))
    out = sharding.place(odd, names, slots=251)
    assert out.columns == ["doc_id", "_slot", "_shard", "row", "at", "slot", "shard"]
    assert {(r._slot, r._shard, r.row, r["at"]) for r in out.collect()} == {(1, 2, 3, 4)} and out.filter("slot <> 5").count() > 0


def test_shards_are_written_in_few_files(spark, docs, tmp_path):
    names = [f"s{k}" for k in range(3)]
    sharding.write_shards(docs.repartition(8), str(tmp_path / "o"), names)
    assert len(list((tmp_path / "o").rglob("*.parquet"))) <= 3
    assert spark.read.parquet(str(tmp_path / "o")).count() == docs.count()


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = docs.select("text", sentencepieces.SentencePieces(docs, path).digest(F.col("text")).alias("d"))
    for r in got.collect():
        ids = lib.encode(r.text or "")
        assert r.d.n_tokens == len(ids)
        assert r.d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.d.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    codec = sentencepieces.PieceCodec(sentencepieces.read_vocabulary(path))
    rnd = random.Random(2)
    parts = ["a", "th", "e", " ", "   ", "\n", "é", "½", "🤣", "日", "▁", "ing", "aaa", "0000", " " * 17, "\x00", "====", "́"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert codec.encode(t) == lib.encode(t)
        ids = [rnd.randrange(32000) for _ in range(rnd.randint(0, 6))]
        assert codec.decode(ids) == lib.decode(ids)
    assert sentencepieces.encoded(empty, path).count() == 0


def test_language_model(docs, empty):
    got = backoff_lm.score_documents(docs, chunk_bytes=50_000, state_share=1e-3).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(_low(t)), "\n"]
    c = collections.Counter(w for r in _rows() if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = [(r[0], out(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 5)) for r in _rows()]
    assert sorted(((*tuple(r)[:5], round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    assert backoff_lm.score_documents(empty).count() == 0


@pytest.mark.parametrize(("share", "chunk"), [(1e-3, 50_000), (0.9, 50_000), (0.02, 1 << 30)])
def test_language_model_counts_every_ngram(docs, share, chunk):
    got = backoff_lm.score_documents(docs, chunk_bytes=chunk, state_share=share).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(_low(t)), "\n"]
    c, pairs, triples, kinds = (collections.Counter() for _ in range(4))
    for t in (tokens(r[1]) for r in _rows() if not out(r[0])):
        c.update(t)
        pairs.update(zip(t[:-1], t[1:], strict=True))
        triples.update(zip(t[:-2], t[1:-1], t[2:], strict=True))
    kinds.update(a for a, _ in pairs)
    kinds.update((a, b) for a, b, _ in triples)
    n, v, once, twice = sum(c.values()), len(c), sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    d = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))

    def chance(a, b, w):
        p = (c[w] - d) / n if c[w] else d * v / n
        if b is not None and c[b]:
            p = max(0, pairs[b, w] - d) / c[b] + d * kinds[b] / c[b] * p
        if a is not None and pairs[a, b]:
            p = max(0, triples[a, b, w] - d) / pairs[a, b] + d * kinds[a, b] / pairs[a, b] * p
        return p

    def score(t):
        return sum(math.log10(chance(a, b, w)) for a, b, w in zip([None, None, *t], [None, *t], t, strict=False))

    want = [(r[0], score(tokens(r[1]))) for r in _rows()]
    got, want = sorted(((r.doc_id, round(r.score, 4)) for r in got), key=str), sorted(((i, round(s, 4)) for i, s in want), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-3)
    every = [*c, "never seen"]
    for a, b in [("a", "a"), ("one", "two"), ("w1", "w2")]:
        assert sum(chance(a, b, w) for w in every) == pytest.approx(1)


def test_language_model_does_not_depend_on_how_rows_are_dealt(docs):
    got = [sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in backoff_lm.score_documents(docs.repartition(k), chunk_bytes=100_000).collect()), key=str) for k in (1, 12)]
    assert got[0] == got[1]


def test_automaton_weights_add_up_to_one():
    # words 0 to 2; pairs 01 and 02 seen 3 times each, 12 once; state 01 with 2 once and 0 twice
    pairs = [(0, 1, 3), (0, 2, 3), (1, 2, 1), (1, 0, 2)]
    first, second, pair_n = (np.array(x) for x in zip(*pairs, strict=True))
    a = backoff_lm.Automaton((15, 3, 0.5), np.array([6, 4, 5]), np.array([6, 3, 0]), np.array([2, 2, 0]), first, second, pair_n, np.array([0]), np.array([2]), np.array([0, 0]), np.array([2, 3]), np.array([1, 2]))
    at = {(f, s): k for k, (f, s, _) in enumerate(pairs)}
    unknown = 0.5 * 3 / 15
    for before, slot, triple in ((0, -1, {}), (1, -1, {}), (1, 0, {2: 0, 0: 1})):
        left = (10 ** a.deep_fail[slot] if slot >= 0 else 1.0) * 10 ** a.fail[before]
        seen = [a.walk(np.array([w]), np.array([before]), np.array([at.get((before, w), -1)]), np.array([slot]), np.array([triple.get(w, -1)]))[0] for w in range(3)]
        assert sum(10**x for x in seen) + left * unknown == pytest.approx(1)


def test_mixing(docs, empty):
    got = mixing.mix(docs, blocks=3).toPandas()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(got["size"]) == sorted(size(r[1]) for r in _rows())
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (per.taken - per.target).abs().max() < 1
    assert (got.taken <= 2 * got["size"]).all() and (per.target <= 2 * per["size"] + 1e-6).all()
    assert per.target.sum() == pytest.approx(min(1.5, 2) * per["size"].sum())
    again = mixing.mix(docs.repartition(5), blocks=3).toPandas()
    key = ["doc_id", "taken", "source"]
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))
    assert mixing.mix(empty).count() == 0
    times = [r.first_time for r in mixing.mix(docs).collect() if r.first_time is not None]
    assert times == sorted(times)


def test_quality(docs, empty, spark):
    got = quality_rules.judged(docs, quality_rules.DecisionList([])).collect()
    for r in got:
        w = WORD.findall(r.text or "")
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if c[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        s = r._stats
        assert (s.n_words, s.word_chars, s.n_repeat_words, s.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert s.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r._base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality_rules.judged(empty, quality_rules.DecisionList([])).count() == 0
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 4] > 0.5)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(900, bool)
    for conditions, _ in rules.rules:
        hit |= quality_rules._met(x, [(quality_rules.FEATURES.index(n), s, b) for n, s, b in conditions])
    assert hit[bad].mean() > 0.9 and bad[hit].mean() > 0.9
    none = quality_rules.fit_rules(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.rules == []


def test_language(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op9_language_id"](spark, SF).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    model = language_id.fit_centroids(table)
    odd = {r.text: r.l.lang_pred for r in docs.select("text", language_id.language_of(docs, model, F.col("text")).alias("l")).collect()}
    assert odd[None] == odd[""] == odd["  \n"] == "und"
    assert language_id.fit_centroids(empty) is None


def test_toxicity(spark, docs, empty):
    net = toxicity.train(["you worthless fool " + "word " * 40] * 3 + ["kind words here " + "word " * 40] * 9, np.array([1.0] * 3 + [0.0] * 9), steps=150)
    got = {r.text: r.s for r in docs.select("text", toxicity.toxicity_of(docs, net, F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    part = next(iter(toxicity.slices(__import__("pyarrow").array(["x " * 90 + "you worthless fool " + "word " * 90, "word " * 200]))))
    bad, good = net.probability(part)
    assert bad > 0.5 > good
    flat = toxicity.fit_network(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert flat.probability(part).tolist()[0] < 0.5


def test_gradients_agree_with_differences():
    import pyarrow as pa

    text = next(iter(toxicity.slices(pa.array(["aa bb cc dd aa", "ee bb ff"]))))
    row, of, kinds, ids, begins = toxicity._inputs(text)
    begin, length, _ = toxicity._windows(row, 2)
    index = of[np.minimum(begin[:, None] + np.arange(toxicity.WINDOW), len(of) - 1)]
    net = toxicity.Network(kinds[:3])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y = np.array([1.0, 0.0])

    def loss():
        x = net.vectors(kinds, ids, begins)
        logit = net.forward({d: x @ net.p["w" + d] + net.p["c" + d] for d in "fb"}, index, length)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    g, _ = net.gradients(kinds, ids, begins, index, length, y)
    for name in ("uf", "ub", "wf", "att", "query", "out", "word", "gram"):
        flat = net.p[name].reshape(-1)
        at = int(np.argmax(np.abs(g[name])))
        keep, h = flat[at], 1e-3
        flat[at] = keep + h
        up = loss()
        flat[at] = keep - h
        down = loss()
        flat[at] = keep
        assert np.asarray(g[name]).reshape(-1)[at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=1e-4)


def test_toxicity_scores_agree_with_a_plain_network():
    import pyarrow as pa

    words = " ".join(f"w{k % 37}" for k in range(150))
    texts = ["one two three", "", words, "solo " + words[:200]]
    net = toxicity.Network(toxicity._inputs(next(iter(toxicity.slices(pa.array(texts)))))[2][:9])
    net.calibration = np.array([2.0, 0.3, -0.1])
    p, size = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def gru(d, xs):
        h, out = np.zeros(size), []
        for x in xs:
            a = x @ p["w" + d] + p["c" + d]
            z = sig(a[:size] + h @ p["u" + d][:, :size])
            r = sig(a[size : 2 * size] + h @ p["u" + d][:, size : 2 * size])
            c = np.tanh(a[2 * size :] + (r * h) @ p["u" + d][:, 2 * size :])
            h = h + z * (c - h)
            out.append(h)
        return out

    want = []
    for t in texts:
        worst, many = -20.0, 0
        if t:
            _, of, kinds, ids, begins = toxicity._inputs(next(iter(toxicity.slices(pa.array([t])))))
            at = {int(w): k for k, w in enumerate(net.words)}
            vector = [np.concatenate([p["word"][at.get(int(kinds[k]), toxicity.WORDS)], p["gram"][ids[begins[k] : begins[k + 1]]].mean(axis=0)]) for k in of]
            begin = 0
            while True:
                xs = vector[begin : begin + toxicity.WINDOW]
                states = np.hstack([np.array(gru("f", xs)), np.array(gru("b", xs[::-1])[::-1])])
                e = np.tanh(states @ p["att"]) @ p["query"]
                a = np.exp(e - e.max())
                worst = max(worst, float((a / a.sum()) @ states @ p["out"] + p["bias"][0]))
                many += 1
                if begin + toxicity.WINDOW >= len(vector):
                    break
                begin += toxicity.STRIDE
        want.append(sig(2.0 * worst + 0.3 * np.log1p(many) - 0.1))
    assert net.probability(next(iter(toxicity.slices(pa.array(texts))))).tolist() == pytest.approx(want, abs=1e-4)


def test_token_counts_of_sections_agree_with_a_plain_count(docs):
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=token_counts.read_ranks(path), special_tokens={})
    got = collections.Counter((r.doc_id, r.section, r.n_bytes, r.n_tokens, r.n_crossing, r.doc_tokens) for r in token_counts.section_token_counts(docs, path, tokenizer_pattern()).collect())
    want = collections.Counter()
    for i, text, *_ in _rows():
        lines = re.findall("[^\n]*\n|[^\n]+$", text or "") or [""]
        if (text or "").endswith("\n"):
            lines.append("")
        starts = np.cumsum([0, *(len(x.encode()) for x in lines)])
        n, over, at = [0] * len(lines), [0] * len(lines), 0
        ids = enc.encode_ordinary(text or "")
        of = lambda byte: int(np.searchsorted(starts[: len(lines)], byte, side="right")) - 1
        for token in ids:
            size = len(enc.decode_single_token_bytes(token))
            n[of(at)] += 1
            over[of(at)] += of(at + size - 1) != of(at)
            at += size
        want.update((i, k, len(x.encode()), n[k], over[k], len(ids)) for k, x in enumerate(lines))
    # a newline at the very end opens no further section
    drop_empty_ends = lambda c: collections.Counter({k: v for k, v in c.items() if k[2] or k[1] == 0})
    assert drop_empty_ends(got) == drop_empty_ends(want)
