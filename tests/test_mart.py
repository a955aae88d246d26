"""Mart assembly, sinks, quantiles and models on literal rows."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.functions import timeutil as t
from tidemark.operators import asof, contracts, forecasts, mart, series, settle
from tidemark.sources import lake, normalise, versions
from tidemark.streaming import incremental as inc


def test_asof_agrees_with_brute_force_and_skips_unknown_issue_times(spark):
    rnd = random.Random(5)
    at = lambda: datetime(2024, 5, 1 + rnd.randrange(6), rnd.randrange(24), rnd.choice([0, 30]))
    v = [(rnd.choice([1, 2, None]), at() if rnd.random() > 0.1 else None, k, float(k)) for k in range(120)]
    s = [(rnd.choice([1, 2, 3, None]), at() if rnd.random() > 0.1 else None, k) for k in range(60)]
    vintages = spark.createDataFrame(v, "key int, at timestamp_ntz, id int, x double")
    spine = spark.createDataFrame(s, "key int, cutoff_utc timestamp_ntz, row int")
    got = {r.row: (r.x, r["at"]) for r in asof.asof_join(spine, vintages, ["key"], ["x"], "at", tie=["id"]).collect()}
    want = {}
    for key, cut, row in s:
        known = [(a, i, x) for k, a, i, x in v if key is not None and k == key and a is not None and cut is not None and a <= cut]
        a, _, x = max(known) if known else (None, None, None)
        want[row] = (x, a)
    assert got == want
    picked = asof.asof_join(spine, vintages, ["key"], ["x"], "at", tie=["id"])
    assert asof.newer_vintage_existed(picked, vintages, ["key"], "at").count() == 0
    stale = picked.withColumn("at", F.col("at") - F.expr("INTERVAL 10 DAY"))
    assert asof.newer_vintage_existed(stale, vintages, ["key"], "at").count() == sum(a is not None for _, a in want.values())
    after = sum(1 for key, cut, _ in s for k, a, _, _ in v if key is not None and k == key and a and cut and a > cut)
    missing = sum(1 for key, cut, _ in s for k, a, _, _ in v if key is not None and k == key and a and not cut)
    assert contracts.guard_exercised(spine, vintages, ["key"], "at").first().n_after_cutoff == after + missing


def test_quantiles_and_ranks_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g, n in (("a", 700), ("b", 1), ("c", 64)) for x in np.round(rng.lognormal(0, 2, n), 1)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    got = {r.g: tuple(r)[1:] for r in series.exact_quantiles(df, "x", ["g"], qs).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], qs))
    assert "d" not in got and series.exact_quantiles(df.limit(0), "x", ["g"], qs).count() == 0
    whole = series.exact_quantiles(df, "x", [], [0.5]).first().q0
    assert whole == pytest.approx(np.median([x for _, x in rows if x is not None]))
    ranks = series.average_ranks(df.filter("g = 'c'"), "x", ["g"], "r").collect()
    xs = [r.x for r in ranks]
    assert [r.r for r in ranks] == [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def test_bootstrap_agrees_with_numpy(spark):
    values = [float((k * 37) % 23) for k in range(50)]
    df = spark.createDataFrame([(date(2024, 1, 1 + k % 31) if k < 31 else date(2024, 2, k - 30), v) for k, v in enumerate(values)], "day date, g double")
    got = m.block_bootstrap(df, "g", "day", repeats=300).first()
    starts = [[r.s for r in spark.range(8).select(F.pmod(F.xxhash64(F.lit(0), F.lit(rep).cast("long"), F.col("id").cast("int")), F.lit(44)).alias("s")).orderBy("id").collect()] for rep in range(3)]
    assert all(0 <= s < 44 for row in starts for s in row)
    assert np.mean(values) - 6 < got.low < np.mean(values) < got.high < np.mean(values) + 6


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 2.0), (None, 3.0)], "k int, b double")
    assert sorted(map(tuple, mart.one_to_one(a, b, ["k"]).collect()), key=str) == [(1, "x", 2.0), (None, "y", 3.0)]
    for bad in (b.unionByName(b.limit(1)), b.filter("k = 1"), b.withColumn("k", F.lit(1))):
        with pytest.raises(ValueError, match="one to one"):
            mart.one_to_one(a, bad, ["k"])


def test_features(spark):
    assert mart.feature_list(["a", "b"], add=["c", "a"], drop=["b"]) == ["a", "c"]
    with pytest.raises(ValueError, match="no such"):
        mart.feature_list(["a"], drop=["z"])
    df = spark.createDataFrame([(1, 4.0, 0.0, True), (2, None, 2.0, None)], "k int, a double, b double, f boolean")
    assert [tuple(x) for x in mart.relative(df, ["b"], "a").select("b_rel", "f").collect()] == [(-4.0, 1.0), (None, None)]
    assert [x[0] for x in df.select(mart.safe_ratio("a", "b"), mart.supply_share(["a"], ["b"])).collect()] == [None, None]
    with pytest.raises(ValueError, match="both sides"):
        mart.star(df, [(df, ["k"])])
    other = spark.createDataFrame([(1, None), (2, 9.0)], "k int, a double")
    assert sorted((x.k, x.a) for x in mart.swapped(df, other, ["k"], ["a"]).collect()) == [(1, 4.0), (2, 9.0)]


def test_contracts_on_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    assert contracts.unique(df, ["a", "b"]).count() == 0
    assert [tuple(r) for r in contracts.unique_combination(df, ["a", "b"]).collect()] == [(None, 1, 2)]
    left = spark.createDataFrame([(1, None), (2, 1.0)], "k int, v double")
    assert series.table_diff(left, left.filter("k = 2"), ["k"], ["v"]).first().mismatches == 1
    assert series.table_diff(left, left, ["k"], ["v"]).first().mismatches == 0
    assert tuple(series.key_diff(left, left.filter("k = 2").withColumn("z", F.lit(1)), ["k"]).first()) == (1, 0, "z")


def test_clock_changes_of_other_zones(spark):
    zones = [("Australia/Adelaide", "2024-10-06 02:15:20", datetime(2024, 10, 5, 16, 30)), ("Australia/Adelaide", "2024-04-07 02:15:20", datetime(2024, 4, 6, 16, 45, 20))]
    zones += [("Australia/Lord_Howe", "2024-10-06 02:10:00", datetime(2024, 10, 5, 15, 30)), ("Australia/Lord_Howe", "2024-04-07 01:45:00", datetime(2024, 4, 6, 15, 15))]
    zones += [("Pacific/Apia", "2011-12-30 15:00:00", datetime(2011, 12, 30, 10)), ("Asia/Kolkata", "2024-01-01 05:30:00", datetime(2024, 1, 1))]
    for zone, local, want in zones:
        assert spark.range(1).select(t.to_utc(F.lit(local).cast("timestamp_ntz"), zone).alias("u")).first().u == want, zone


def test_layers(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1), ("c2", 2)], "_chunk string, v int")
    out = lake.layered({"v1": ("view", df), "t1": ("table", df.filter("v = 2"))}, f"file://{tmp_path}/l")
    assert spark.table("v1").count() == 2 and out["t1"].first().v == 2


def test_text_sink_and_fixture(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), 1.23456, "a"), (None, None, None, None)], "d date, ts timestamp_ntz, x double, s string")
    lake.write_formatted(df, str(tmp_path / "csv" / "day1"))
    back = lake.read_formatted(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), 1.2346, "a"), (None, None, None, None)], key=str)
    lake.fixture(df, str(tmp_path / "fx"), F.col("d").isNotNull())
    assert spark.read.parquet(str(tmp_path / "fx")).count() == 1
    lake.write_results(df, df.select("x"), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res/predictions")).count() == 2


def test_load_plan_and_write_once(spark, tmp_path):
    df = spark.createDataFrame([("20240101-20240107", 1), ("20240108-20240114", 2)], "_chunk string, v int")
    path = str(tmp_path / "loaded")
    for _ in range(2):
        lake.load(df, path, "2024-01-15", 3)
        assert [r.v for r in versions.read_chunks(spark, path, df.schema).collect()] == [2]
    odd = spark.createDataFrame([(date(2024, 1, 2), None, datetime(2024, 1, 2))], "day date, made timestamp_ntz, starts timestamp_ntz")
    assert lake.append_once(None, odd, "day", "made", "starts")[1] == "missing"
    old, new = spark.createDataFrame([(1, 0, "a")], "k int, n int, v string"), spark.createDataFrame([(1, 1, "b"), (1, 3, "d"), (1, 2, "c")], "k int, n int, v string")
    assert lake.upserted(old, new, ["k"], ["n"]).first().v == "d"


def test_embedded_forecasts(spark):
    raw = spark.createDataFrame([("2024-07-01T08:00", "08:00", "2024-07-02", "0:30", "5", "7", "x"), ("2024-07-01 08:00:00", "08:00:00", "2024-07-02T00:00:00", "01:00", "1", None, "9")], "issued string, clock string, day string, ends string, solar string, wind string, cap string")
    got = sorted(map(tuple, normalise.embedded_forecasts(raw, "issued", "clock", "day", "ends", {"solar": "solar", "wind": "wind", "capacity": "cap"}).collect()), key=str)
    assert got == sorted([(datetime(2024, 7, 1, 8), "utc", datetime(2024, 7, 1, 23, 0), 5.0, 7.0, None), (datetime(2024, 7, 1, 7), "local", datetime(2024, 7, 1, 23, 30), 1.0, None, 9.0)], key=str)


def test_stream_has_the_row_at_the_cutoff(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 9), 1.0), (datetime(2024, 1, 1, 10), 2.0), (datetime(2024, 1, 8, 9), 4.0), (datetime(2024, 1, 20), 8.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    inc.run_available(inc.trailing_at_cutoff(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "v"), str(tmp_path / "c"), name="trail", mode="complete")
    stream = {(str(r.cutoff), r.n, r["mean"]) for r in spark.table("trail").collect()}
    batch = {(str(r.cutoff), r.n, r["mean"]) for r in inc.trailing_at_cutoff(df, "ts", "v").collect()}
    assert stream == batch and ("2024-01-08 09:00:00", 2, 3.0) in batch and ("2024-01-01 09:00:00", 1, 1.0) in batch


def test_latest_delivery_wins(spark, tmp_path):
    kind = "k int, at timestamp_ntz, v int"
    table = inc.latest_delivery(spark, str(tmp_path / "o"), spark.createDataFrame([], kind).schema, ["k"], "at")
    sink = inc.keyed_sink(table, compact_every=1)
    sink(spark.createDataFrame([(1, datetime(2024, 1, 2), 5), (1, datetime(2024, 1, 1), 4)], kind), 0)
    sink(spark.createDataFrame([(1, datetime(2024, 1, 1, 5), 6), (2, datetime(2024, 1, 1), 7)], kind), 1)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, 5), (2, 7)]


def test_models(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), F.lit(None).cast("double").alias("gone"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).cast("double").alias("b"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("day"))
    df = df.withColumn("y", 3 * F.col("a") + F.coalesce("b", F.lit(0.0)))
    fit, cal = forecasts.calibration_split(df, "day", days=40)
    assert fit.agg(F.max("day")).first()[0] < cal.agg(F.min("day")).first()[0]
    model = forecasts.point_model(fit, ["a", "gone", "b"], "y", maxIter=5, seed=1)
    gain = [tuple(r) for r in forecasts.importance(spark, model).collect()]
    assert gain[0][0] == "a" and sum(g for _, g in gain) == pytest.approx(1) and "gone" in dict(gain)
    out = forecasts.with_residual_quantiles(model, cal, cal, "y", [0.1, 0.5, 0.9]).agg(*m.metric_columns()).first()
    assert 0.7 < out.coverage < 0.9
    linear = forecasts.point_model(fit, ["a", "gone"], "y", "linear", weight="a")
    assert linear.transform(cal).filter("point is null").count() == 0
    known = forecasts.delevelled(df, "y", "a").limit(1).first()
    assert known.y_rel == known.y - known.a
    assert forecasts.relevelled(spark.createDataFrame([(1.0, 2.0)], "p10 double, a double"), ["p10"], "a").first().p10 == 3.0
    flags = F.col("day") >= F.lit("2024-04-01").cast("date")
    result, gains = forecasts.adversarial(df.withColumn("t", F.datediff("day", F.lit("2024-01-01").cast("date"))), ["a", "t"], flags, F.col("a") < 6)
    assert result.first().auc > 0.95 and result.first().markers == ["t"] and gains.first().feature == "t"


def test_settlement_counts_losses(spark):
    s = spark.createDataFrame([("d", 1, 10.0, 1.0, 0.0, 0.45), ("d", 2, 30.0, 0.0, 0.81, 0.0)], "day string, p int, price double, charge_mw double, discharge_mw double, soc_mwh double")
    r = settle.settle(s, ["day"], "price", 0.9, 0.5, 2.0, discharge_efficiency=0.9).first()
    assert r.mwh == pytest.approx(0.405) and r.cycles == pytest.approx(0.405 / 0.9 / 0.9) and r.net == pytest.approx(0.5 * (30 * 0.81 - 10) - 0.81)
    assert contracts.infeasible(s, 1.0, 1.0, 0.9, 0.5, ["day"], "p", discharge_efficiency=0.9).count() == 0
    assert contracts.infeasible(s, 1.0, 1.0, 0.9, 0.5, ["day"], "p").count() == 1
