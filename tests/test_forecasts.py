"""Metrics, calibration, settlement and payloads on literal rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.operators import forecasts, settle
from tidemark.sources import normalise


def test_pinball_and_coverage(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 2.0), (2.0, 2.5, 3.0, 3.5), (3.0, 2.0, 3.0, 4.0), (None, 0.0, 0.0, 0.0)], "y double, p10 double, p50 double, p90 double")
    r = df.agg(*m.metric_columns()).first()
    assert r.n == 3 and r.coverage == pytest.approx(2 / 3) and r.mae == pytest.approx(1 / 3)
    one = spark.createDataFrame([(10.0, 8.0), (10.0, 12.0)], "y double, q double").select(m.pinball("y", "q", 0.9).alias("l"))
    assert [x.l for x in one.collect()] == pytest.approx([1.8, 0.2])


def test_conformal_moves_coverage_to_nominal(spark):
    df = spark.range(2000).select(F.lit("a").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("y"), F.lit(40.0).alias("p10"), F.lit(50.0).alias("p50"), F.lit(60.0).alias("p90"))
    shifts = forecasts.conformal_shifts(df, "y", [0.1, 0.5, 0.9], ["g"])
    got = forecasts.shifted(df, shifts, [0.1, 0.5, 0.9], ["g"]).agg(*m.metric_columns()).first()
    assert got.coverage == pytest.approx(0.8, abs=0.01)


def test_folds(spark):
    got = [tuple(map(str, r)) for r in forecasts.monthly_folds(spark, "2024-01-01", "2024-02-10").orderBy("fold").collect()]
    assert got == [("2024-01", "2024-01-01", "2024-01-31", "2023-12-30"), ("2024-02", "2024-02-01", "2024-02-10", "2024-01-30")]


def test_fixed_rule_and_best_block(spark):
    df = spark.createDataFrame([("d", k, float(k)) for k in range(12)], "day string, p int, price double")
    sched = settle.fixed_rule(df, ["day"], "p", F.lit(False) | (F.col("p") < 4), F.col("p") >= 6, 1.0, 2.0, 1.0, 0.5)
    rows = sched.withColumn("p", F.col("p").cast("int")).orderBy("p").collect()
    assert [r.charge_mw for r in rows[:4]] == [1.0] * 4 and sum(r.discharge_mw for r in rows) == 4.0
    out = settle.settle(sched.join(df.withColumn("p", F.col("p").cast("string")), ["day", "p"]), ["day"], "price", 2.0, 0.5, 0.0).first()
    assert out.cycles == 1.0 and out.revenue == 0.5 * ((6 + 7 + 8 + 9) - (0 + 1 + 2 + 3))
    assert settle.best_block(df, ["day"], "p", "price", 2).first().best_spread == (11 + 10) - (0 + 1)


def test_too_short_a_window_is_undone(spark):
    df = spark.createDataFrame([("d", k, 1.0) for k in range(4)], "day string, p int, price double")
    sched = settle.fixed_rule(df, ["day"], "p", F.col("p") < 3, F.col("p") == 3, 1.0, 2.0, 1.0, 0.5)
    assert sched.agg(F.sum("charge_mw") + F.sum("discharge_mw")).first()[0] == 0.0


def test_payloads(spark):
    price = spark.createDataFrame([('{"data":[{"startTime":"2024-01-01T00:30:00Z","price":"7.5"}]}',)], "j string").select(F.from_json("j", "data array<struct<startTime:string,price:double>>").alias("x")).select("x.*")
    got = normalise.record_list(price, "data", {"start_time": ("startTime", "iso"), "price": ("price", "double")}).first()
    assert got.start_time == datetime(2024, 1, 1, 0, 30)
    raw = '{"model":"m","location_ids":["a"],"responses":[{"hourly":{"time":["2024-01-05T01:00","2024-01-05T02:00"],"t_previous_day1":[1.0,null],"t_previous_day2":[3.0,4.0]}}]}'
    kind = "model string, location_ids array<string>, responses array<struct<hourly:struct<time:array<string>,t_previous_day1:array<double>,t_previous_day2:array<double>>>>"
    w = spark.createDataFrame([(raw,)], "j string").select(F.from_json("j", kind).alias("x")).select("x.*")
    rows = sorted((r.lead_days, r.t, r.available_at) for r in normalise.parallel_arrays(w, ["t"], [1, 2]).collect())
    assert rows == [(1, 1.0, datetime(2024, 1, 4, 7)), (2, 3.0, datetime(2024, 1, 3, 7)), (2, 4.0, datetime(2024, 1, 3, 8))]
