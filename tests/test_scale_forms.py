"""Panes, prefixes, ranks and draws against plain computations."""

import math
import random
import statistics
from datetime import date, datetime, timedelta
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.operators import folds, forecasts, panes, series
from tidemark.operators.asof import asof_join, newer_vintage_existed

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("per_task", [7, 1 << 20])
def test_quantiles_and_ranks(spark, monkeypatch, per_task):
    monkeypatch.setattr(series, "PER_TASK", per_task)
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.5, 2.5, rnd.random()]), rnd.randrange(9) / 2) for _ in range(300)] + [("one", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(3)
    for qs in ([0.1, 0.5, 0.9], [0.0, 1.0]):
        got = {r.g: tuple(r)[1:] for r in series.exact_quantiles(df, "v", ["g"], qs).collect()}
        for g in ("a", "b", None, "one"):
            assert got[g] == pytest.approx(np.quantile([v for x, v, _ in rows if x == g and v is not None], qs))
    whole = series.exact_quantiles(df, "v", [], [0.25]).first()[0]
    assert whole == pytest.approx(np.quantile([v for _, v, _ in rows if v is not None], 0.25))
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    ranked = series.average_ranks(df.filter("g = 'a'"), "v", ["g"], "r").collect()
    own = sorted(v for g, v, _ in rows if g == "a" and v is not None)
    assert sorted(r.r for r in ranked if r.v is not None) == pytest.approx(sorted(rank(own))) and all(r.r is None for r in ranked if r.v is None)
    for r in series.spearman(df.filter("g is not null"), "v", "w", ["g"]).collect():
        x, y = zip(*[(v, w) for g, v, w in rows if g == r.g and v is not None], strict=True)
        assert r.n == len(x) and (r.rank_corr is None if len(x) == 1 else r.rank_corr == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]))
    scored = spark.createDataFrame([(g, w, rnd.random() < 0.3 + w / 9) for g, _, w in rows if g], "g string, s double, y boolean")
    pairs = scored.collect()
    for r in series.auc(scored, "s", "y", ["g"]).collect():
        pos, neg = ([p.s for p in pairs if p.g == r.g and p.y == y] for y in (True, False))
        if pos and neg:
            assert r.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        else:
            assert r.auc is None
        assert (r.positives, r.negatives) == (len(pos), len(neg))


def test_panes_agree_with_bands(spark):
    rnd = random.Random(4)
    rows = [(T0 + timedelta(minutes=rnd.choice([rnd.randrange(20_000), 60 * rnd.randrange(330)])), rnd.choice([None, 1e6 + rnd.random()]), k) for k in range(600)]
    cuts = [T0 + timedelta(hours=9 + 24 * k - (k > 6)) for k in range(-1, 16)] + [T0 + timedelta(days=90)]
    days = spark.createDataFrame([(c,) for c in cuts], "cut timestamp_ntz")
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, id int").repartition(3)
    width = panes.pane_width(days, "cut", [7 * 86400, 86400])
    assert width == 3600
    paned = panes.panes(df, "ts", width, {"v": F.col("v"), "big": F.when(F.col("v") > 1e6 + 0.5, F.col("v"))}, last={"now": (F.col("v"), ["id"])})
    for seconds in (86400, 7 * 86400):
        got = {r.cut: r for r in panes.combined(days, paned, "cut", seconds, width, ["v", "big"], last=["now"]).collect()}
        for c in cuts:
            band = [(t, v, k) for t, v, k in rows if c - timedelta(seconds=seconds) < t <= c]
            vs = [v for _, v, _ in band if v is not None]
            r = got[c]
            assert r.v_n == len(vs) and r.newest == max((t for t, _, _ in band), default=None)
            assert r.big_n == sum(v > 1e6 + 0.5 for v in vs)
            assert r.now_last == max(((t, k, v) for t, v, k in band if v is not None), default=(None, None, None))[2]
            if vs:
                assert (r.v_mean, r.v_low, r.v_high, r.v_total) == pytest.approx((statistics.fmean(vs), min(vs), max(vs), sum(vs)))
                assert r.v_at == max(t for t, v, _ in band if v is not None)
            else:
                assert r.v_mean is None and r.v_total is None
            assert r.v_sd == pytest.approx(statistics.stdev(vs), rel=1e-6) if len(vs) > 1 else r.v_sd is None
    with pytest.raises(ValueError):
        panes.pane_width(spark.createDataFrame([(T0 + timedelta(microseconds=1),)], "cut timestamp_ntz"), "cut", [86400])


def _days(rnd, n=500):
    return [(date(2022, 1, 5) + timedelta(rnd.randrange(700)), rnd.gauss(5, 2), rnd.random(), rnd.choice([None, rnd.gauss(1000, 9)])) for _ in range(n)]


def test_fold_sums_agree_with_joined_rows(spark):
    rows = _days(random.Random(1))
    df = spark.createDataFrame(rows, "day date, a double, b double, y double").repartition(3)
    some = forecasts.monthly_folds(spark, "2021-11-01", "2024-03-10")
    sums = folds.day_prefixes(df, "day", {"n": F.lit(1), "y": F.col("y")})
    for last in (None, 100):
        got = {r.fold: r for r in folds.fold_sums(some, sums, ["n", "y"], last).collect()}
        assert len(got) == 29
        for f in some.collect():
            train = [r for r in rows if r[0] <= f.train_end and (last is None or r[0] > f.train_end - timedelta(last))]
            test = [r for r in rows if f.test_start <= r[0] <= f.test_end]
            r = got[f.fold]
            assert (r.train_n, r.test_n) == (len(train), len(test))
            assert r.train_y == pytest.approx(sum(x[3] or 0 for x in train)) and r.test_y == pytest.approx(sum(x[3] or 0 for x in test), abs=1e-6)


@pytest.mark.parametrize(("half_life", "last"), [(None, None), (None, 120), (45.0, None)])
def test_linear_folds_agree_with_numpy(spark, half_life, last):
    rows = [(d, a, b, None if y is None else 3 * a - 40 * b + y) for d, a, b, y in _days(random.Random(7))] + [(date(2022, 3, 1), None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "day date, a double, b double, y double").repartition(3)
    some = forecasts.monthly_folds(spark, "2022-01-01", "2023-12-20")
    models = folds.linear_folds(df, some, ["a", "b"], "y", "day", half_life, last).cache()
    got = {r.fold: r for r in models.collect()}
    for f in some.collect():
        train = [r for r in rows if None not in r and r[0] <= f.train_end and (last is None or r[0] > f.train_end - timedelta(last))]
        if len(train) < 5:
            continue
        w = np.array([0.5 ** ((f.train_end - r[0]).days / half_life) if half_life else 1.0 for r in train]) ** 0.5
        x = np.array([[1.0, r[1], r[2]] for r in train])
        want = np.linalg.lstsq(x * w[:, None], np.array([r[3] for r in train]) * w, rcond=None)[0]
        assert [got[f.fold].intercept, *got[f.fold].beta] == pytest.approx(want.tolist(), rel=1e-6)
    assert got["2022-01"].beta is None
    test = folds.tested(df, some, "day")
    for r in folds.predicted(test, models, ["a", "b"]).filter("a is not null and fold = '2023-05'").collect():
        c = got[r.fold]
        assert r.point == pytest.approx(c.intercept + c.beta[0] * r.a + c.beta[1] * r.b)
    assert test.filter("fold = '2023-05'").count() == sum(r[0].year == 2023 and r[0].month == 5 for r in rows)


def test_design_agrees_with_numpy(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.gauss(5, 2) if rnd.random() > 0.3 else None, 3.0, None) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, a double, flat double, gone double")
    out, names = forecasts.linear_design(df.filter("k < 150"), df, ["a", "flat", "gone"])
    assert names == ["a_z", "flat_z", "gone_z", "a_missing", "gone_missing"]
    train = [a for k, a, _, _ in rows if k < 150]
    middle = np.median([a for a in train if a is not None])
    fill = np.array([middle if a is None else a for a in train])
    for r in out.collect():
        a = middle if r.a is None else r.a
        assert r.a_z == pytest.approx((a - fill.mean()) / fill.std(ddof=1)) and (r.flat_z, r.gone_z) == (0.0, 0.0)
        assert (r.a_missing, r.gone_missing) == (float(r.a is None), 1.0)


@pytest.mark.parametrize("bucket", ["HOUR", "MONTH"])
def test_asof_does_not_depend_on_its_buckets(spark, bucket):
    rnd = random.Random(3)
    v = spark.createDataFrame([(rnd.randrange(3), T0 + timedelta(minutes=rnd.randrange(20_000)), k) for k in range(150)], "k int, at timestamp_ntz, x int")
    s = spark.createDataFrame([(rnd.randrange(4), T0 + timedelta(minutes=rnd.randrange(20_000)), k) for k in range(80)], "k int, cutoff_utc timestamp_ntz, row int")
    rows = lambda **more: sorted(map(str, asof_join(s, v, ["k"], ["x"], "at", tie=["x"], **more).collect()))
    assert rows(bucket=bucket) == rows()


def test_bootstrap_agrees_with_plain_draws(spark):
    rnd = random.Random(0)
    for n in (1, 5, 30):
        rows = [(date(2024, 1, 1) + timedelta(2 * k), rnd.random()) for k in range(n)] + [(date(2024, 1, 2), None)]
        got = m.block_bootstrap(spark.createDataFrame(rows, "day date, g double"), "g", "day", repeats=200, seed=3).first()
        v = [g for _, g in sorted(rows) if g is not None]
        means = []
        for rep in range(200):
            picks = []
            for k in range(math.ceil(n / 7)):
                start = int(md5(f"3-{rep}-{k}".encode()).hexdigest()[:8], 16) % max(n - 6, 1)
                picks += v[start : start + min(7, n - 7 * k)]
            means.append(sum(picks) / n)
        assert (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    none = m.block_bootstrap(spark.createDataFrame([], "day date, g double"), "g", "day", repeats=5).first()
    assert none.low is None


def test_newer_vintages_are_found_in_one_timeline(spark):
    rnd = random.Random(6)
    v = [(rnd.randrange(4), T0 + timedelta(hours=rnd.randrange(300)), k) for k in range(120)]
    s = [(k, T0 + timedelta(hours=rnd.randrange(-20, 320))) for k in range(5) for _ in range(8)]
    vintages, spine = spark.createDataFrame(v, "k int, at timestamp_ntz, x int"), spark.createDataFrame(list(set(s)), "k int, cutoff_utc timestamp_ntz")
    good = asof_join(spine, vintages, ["k"], ["x"], "at", tie=["x"])
    assert newer_vintage_existed(good, vintages, ["k"], "at").count() == 0
    old = good.withColumn("at", F.when(F.col("k") != 1, F.col("at") - F.expr("INTERVAL 1 SECOND")))
    want = {(r.k, r.cutoff_utc): sum(k == r.k and t <= r.cutoff_utc and (r.at is None or t > r.at) for k, t, _ in v) for r in old.collect()}
    twice = newer_vintage_existed(old.unionByName(old), vintages, ["k"], "at").collect()
    assert {(r.k, r.cutoff_utc): r.n_newer for r in twice} == {k: n for k, n in want.items() if n} and len(twice) == 2 * sum(n > 0 for n in want.values())


def test_cross_fitting_scores_each_row_once(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(11)).cast("double").alias("b"), (F.col("id") % 3).alias("block")).withColumn("later", F.col("a") > 3)
    scored = forecasts.cross_fitted(df, ["a", "b"], "later", "block", 3, maxIter=3)
    assert scored.count() == 300 and forecasts.separability(scored, "later", []).first().auc > 0.99
    blind = forecasts.cross_fitted(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"], "later", "block", 3, maxIter=3)
    assert 0.3 < forecasts.separability(blind, "later", []).first().auc < 0.7


def test_residual_forecast(spark):
    rnd = random.Random(9)
    rows = [(date(2023, 1, 1) + timedelta(k // 3), float(k % 10), 2.0 * (k % 10) + rnd.gauss(0, 1)) for k in range(900)]
    train = spark.createDataFrame(rows[:800], "day date, x double, y double")
    out = forecasts.residual_forecast(train, spark.createDataFrame(rows[800:], "day date, x double, y double"), ["x"], "y", "day", [0.1, 0.5, 0.9]).agg(*m.metric_columns()).first()
    assert 0.65 < out.coverage < 0.95 and out.mae < 1.2
