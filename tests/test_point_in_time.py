"""As-of joins, bands, calendar and contracts on literal rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions import timeutil as t
from tidemark.operators import contracts
from tidemark.operators.asof import asof_join, newer_vintage_existed
from tidemark.operators.band import trailing
from tidemark.operators.calendar import settlement_calendar
from tidemark.operators.series import interpolated, missingness, table_diff, weighted_mean
from tidemark.sources import lake

CUT = datetime(2024, 7, 1, 8)


def _vintages(spark):
    rows = [(1, datetime(2024, 7, 1, 7, 15), 90.0), (1, datetime(2024, 7, 1, 7, 45), 100.0), (1, datetime(2024, 7, 1, 8, 15), 999.0), (2, datetime(2024, 7, 1, 8, 15), 999.0)]
    return spark.createDataFrame(rows, "period int, at timestamp_ntz, mw double")


def _spine(spark):
    return spark.createDataFrame([(1, CUT), (2, CUT), (3, CUT)], "period int, cutoff_utc timestamp_ntz")


def test_asof_takes_the_newest_before_the_cutoff(spark):
    got = asof_join(_spine(spark), _vintages(spark), ["period"], ["mw"], "at")
    rows = {r.period: (r.mw, r["at"]) for r in got.collect()}
    assert rows == {1: (100.0, datetime(2024, 7, 1, 7, 45)), 2: (None, None), 3: (None, None)}
    assert newer_vintage_existed(got, _vintages(spark), ["period"], "at").count() == 0
    assert contracts.point_in_time(got, {"at": ["mw"]}).count() == 0
    assert asof_join(_spine(spark), _vintages(spark), ["period"], ["mw"], "at", how="inner").count() == 1


def test_a_leaky_join_is_caught(spark):
    leaky = asof_join(_spine(spark), _vintages(spark), ["period"], ["mw"], "at", shift_minutes=180)
    assert contracts.point_in_time(leaky, {"at": ["mw"]}).count() == 2


def test_calendar_has_short_and_long_days(spark):
    for day, n in (("2024-03-30", 48), ("2024-03-31", 46), ("2024-10-27", 50)):
        cal = settlement_calendar(spark, day, day)
        assert cal.count() == n
        assert contracts.clock_changes(cal, "Europe/London").count() == 0
    first = settlement_calendar(spark, "2024-07-02", "2024-07-02").first()
    assert first.cutoff_utc == CUT
    assert settlement_calendar(spark, "2024-01-16", "2024-01-16").first().cutoff_utc == datetime(2024, 1, 15, 9)


def test_local_times_that_occur_twice_or_never(spark):
    rows = [("2023-10-29 01:47:00",), ("2021-08-05 14:03:09",), ("2024-03-31 01:30:00",)]
    got = [r.u for r in spark.createDataFrame(rows, "s string").select(t.to_utc(F.col("s").cast("timestamp_ntz"), "Europe/London").alias("u")).collect()]
    assert got == [datetime(2023, 10, 29, 1, 47), datetime(2021, 8, 5, 13, 3, 9), datetime(2024, 3, 31, 1, 0)]


def test_band_is_half_open_and_not_a_nested_loop(spark):
    days = spark.createDataFrame([(CUT,), (datetime(2024, 7, 9, 8),)], "cutoff_utc timestamp_ntz")
    rows = [(datetime(2024, 6, 24, 8), 1.0), (datetime(2024, 6, 24, 8, 0, 1), 2.0), (CUT, 4.0), (datetime(2024, 7, 1, 8, 0, 1), 8.0)]
    series = spark.createDataFrame(rows, "at timestamp_ntz, v double")
    got = trailing(days, series, "cutoff_utc", "at", 7 * 86400, [F.sum("v").alias("s")])
    assert {r.cutoff_utc: r.s for r in got.collect()} == {CUT: 6.0, datetime(2024, 7, 9, 8): None}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_weights_of_nulls_do_not_count(spark):
    df = spark.createDataFrame([(10.0, 1.0), (None, 3.0), (20.0, 1.0)], "v double, w double")
    assert df.agg(weighted_mean("v", "w").alias("m")).first().m == 15.0


def test_interpolation_carries_edges(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 4, 20.0), ("a", 5, None)], "g string, p int, v double")
    assert [r.v_filled for r in interpolated(df, "v", ["g"], "p").orderBy("p").collect()] == [10.0, 10.0, 15.0, 20.0, 20.0]


def test_history_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    h = old.withColumns({"valid_from": F.lit("2024-01-01").cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    got = lake.scd2(h, new, "k", ["v"], "2024-02-01")
    assert sorted((r.k, r.v, r.valid_to is None) for r in got.collect()) == [(1, "a", True), (2, "b", False), (2, "x", True), (3, "c", False), (4, "d", True)]
    assert sorted(map(tuple, lake.upserted(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "x"), (3, "c"), (4, "d")]
    assert table_diff(old, new, ["k"], ["v"]).first().mismatches == 3


def test_write_once(spark):
    made = spark.createDataFrame([(date(2024, 1, 2), datetime(2024, 1, 1, 9), datetime(2024, 1, 2))], "day date, made timestamp_ntz, starts timestamp_ntz")
    late = made.withColumn("made", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    assert lake.append_once(None, made, "day", "made", "starts")[1] == "appended"
    assert lake.append_once(made, made, "day", "made", "starts")[1] == "recorded"
    assert lake.append_once(None, late, "day", "made", "starts")[1] == "late"


def test_missingness(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert [tuple(r) for r in missingness(df, ["a", "b"]).collect()] == [("b", 0.5)]
