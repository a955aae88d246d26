"""Steps that the forecast queries share: no exchange by few groups, tasks of bounded rows, and the SQL's results on odd rows."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecasts, mart, series
from tidemark.plans import catalogue, evaluation  # noqa: F401


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """lineitem and orders with repeated and null keys, groups and values, and a group that has no value."""
    d, rnd = str(tmp_path_factory.mktemp("odd")), random.Random(7)
    lines = []
    for _ in range(900):
        g = rnd.choice([1.0, 2.0, 3.0, 9.0, None])
        y = None if g == 9.0 or rnd.random() < 0.05 else float(rnd.randrange(100, 9000)) / 4
        day = None if rnd.random() < 0.03 else datetime(1995, 1, 1) + timedelta(days=rnd.randrange(900))
        lines.append((rnd.choice([None, *range(60)]), rnd.choice([None, 1, 2, 3]), rnd.randrange(9), g, y, day, rnd.choice(["A", "N", None])))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, rnd.choice("FOP"), 100.5 + (k or 0)) for k in [None, *range(50), 7, 8, 9]], "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    return d


def check(spark, d, name):
    """The query's plan, after its rows were compared with those of its SQL."""
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    out = catalogue.QUERIES[name](spark, d)
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in out.collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert len(got) == len(want) and len(want) > 0
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b, nan_ok=True)
    return out._jdf.queryExecution().toString()


def test_wide_with_actual_in_one_exchange(spark):
    rows = [(1, None, "a", 2.0, 5.0), (1, None, "a", 4.0, 6.0), (1, None, "b", 1.0, None), (1, 1, "b", 3.0, None), (None, 2, "c", 9.0, 8.0)]
    out = mart.wide_with_actual(spark.createDataFrame(rows, "k int, l int, model string, v double, y double").repartition(3), ["k", "l"], "model", ["a", "b"], "v", "y")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, None, 3.0, 1.0, 6.0), (1, 1, None, 3.0, None), (None, 2, None, None, 8.0)], key=str)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_settled_forecasts_deal_lines_once(spark, odd, monkeypatch):
    monkeypatch.setattr(series, "DEALT", 50)
    plan = check(spark, odd, "settled_forecasts")
    assert "hashpartitioning(g#" not in plan and "hashpartitioning(l_quantity#" not in plan
    assert "18), REPARTITION_BY_NUM" in plan
    sizes = series.dealt(catalogue._lines(spark, odd), ("l_orderkey",)).groupBy(F.spark_partition_id()).count()
    assert sizes.count() > 9


@pytest.mark.parametrize("name", ["leaderboard"])
def test_forecasts_on_odd_rows(spark, odd, name):
    check(spark, odd, name)


def test_large_tables_beside_are_not_broadcast(spark, monkeypatch):
    df, table = spark.range(40).withColumn("k", F.col("id") % 7), spark.range(5).toDF("k").withColumn("v", F.col("k") * 2)
    want = {(i, i % 7 * 2 if i % 7 < 5 else None) for i in range(40)}
    for few in (4, 5):
        monkeypatch.setattr(series, "FEW", few)
        assert {(r.id, r.v) for r in series.beside(df, table, ["k"]).collect()} == want


def test_conformal_counts_equal_rows(spark, odd, monkeypatch):
    kept, read = {}, []

    def staged(df, name):
        kept[name] = forecasts_staged(df, name)
        return kept[name]

    forecasts_staged = forecasts.staged
    monkeypatch.setattr(forecasts, "staged", staged)
    monkeypatch.setattr(series, "_counts", lambda df, value, by, f=series._counts: (read.append(by), f(df, value, by))[1])
    check(spark, odd, "conformal")
    lines = spark.read.parquet(f"{odd}/lineitem.parquet")
    assert kept["calibration"].count() == lines.select("l_returnflag", "l_extendedprice").distinct().count() < lines.count()
    assert read == [[]]
    rows = spark.createDataFrame([("a", 3.0)] * 5 + [("a", 1.0), (None, 2.0), ("b", None)], "g string, y double").withColumn("p50", F.lit(1.0))
    for keys, want in ((["g"], {("a", 6, 2.0), (None, 1, 1.0), ("b", 0, None)}), ([], {(7, 2.0)})):
        assert {tuple(r) for r in forecasts.conformal_shifts(rows, "y", [0.5], keys).collect()} == want


def test_paired_verdict_deals_lines_once(spark, odd, monkeypatch):
    monkeypatch.setattr(series, "DEALT", 50)
    read = []
    monkeypatch.setattr(series, "_counts", lambda df, value, by, f=series._counts: (read.append(by), f(df, value, by))[1])
    plan = check(spark, odd, "paired_verdict").split("== Physical Plan ==")[1]
    assert read == [["g"]]
    dealt = [x for x in plan.splitlines() if "hashpartitioning(l_orderkey#" in x]
    assert dealt and all("18), REPARTITION_BY_NUM" in x for x in dealt)
    assert "SortMergeJoin" not in plan and "hashpartitioning(g#" not in plan
