"""Streams give what batches give."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.streaming import incremental as inc

EVENTS = [(1, datetime(2024, 1, 1, 0, 10), 1.0), (1, datetime(2024, 1, 1, 0, 10), 1.0), (2, datetime(2024, 1, 1, 0, 40), 2.0), (3, datetime(2024, 1, 2, 5), 4.0), (4, datetime(2024, 1, 9), 8.0)]


def _stream(spark, tmp_path, rows=EVENTS, schema="id int, ts timestamp_ntz, v double"):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_grid_and_dedup(spark, tmp_path):
    _, s = _stream(spark, tmp_path)
    clean = inc.deduplicated(s, ["id"], "ts", "1 day")
    inc.run_available(clean, str(tmp_path / "c1"), name="clean")
    assert spark.table("clean").count() == 4
    inc.run_available(inc.grid(inc.timed(s, "ts", "1 hour"), "ts", "v"), str(tmp_path / "c2"), name="grid", mode="complete")
    assert {(str(r.start), r.n) for r in spark.table("grid").collect()} >= {("2024-01-01 00:00:00", 2), ("2024-01-01 00:30:00", 1)}


def test_upsert_sink_is_idempotent(spark, tmp_path):
    df, s = _stream(spark, tmp_path)
    table = inc.last_written(spark, str(tmp_path / "out"), df.schema, ["id"], ["ts", "v"])
    sink = inc.keyed_sink(table)
    inc.run_available(s, str(tmp_path / "c"), sink=sink)
    sink(df.withColumn("v", F.lit(99.0)), 0)
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, 1.0), (2, 2.0), (3, 4.0), (4, 8.0)]


def test_newest_vintage_per_target(spark, tmp_path):
    spine = spark.createDataFrame([(1, datetime(2024, 1, 1, 12))], "id int, cutoff_utc timestamp_ntz")
    kind = "id int, ts timestamp_ntz, v double, n int"
    table, fresh = inc.newest_vintages(spine, str(tmp_path / "v"), ["id"], ["v"], "ts", ["n"], schema=spark.createDataFrame([], kind).schema)
    sink = inc.keyed_sink(table, prepare=fresh)
    sink(spark.createDataFrame([(1, datetime(2024, 1, 1, 11), 5.0, 2)], kind), 0)
    sink(spark.createDataFrame([(1, datetime(2024, 1, 1, 10), 4.0, 1), (1, datetime(2024, 1, 1, 13), 6.0, 3)], kind), 1)
    assert table.read().first().v == 5.0
    sink(spark.createDataFrame([(1, datetime(2024, 1, 1, 11), 7.0, 1), (1, datetime(2024, 1, 1, 11), 8.0, 4)], kind), 2)
    assert table.read().first().v == 8.0


def test_forecasts_settle_when_the_actual_arrives(spark, tmp_path):
    f = [(k % 3, datetime(2024, 1, 1, k), float(k)) for k in range(12)]
    a = [(k % 3, datetime(2024, 1, 1, k, 30), 10.0 * k) for k in range(12)]
    spark.createDataFrame(f, "key int, made timestamp_ntz, q double").coalesce(1).write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(a, "key int, at timestamp_ntz, y double").coalesce(1).write.parquet(str(tmp_path / "a"))
    left = inc.timed(spark.readStream.schema("key int, made timestamp_ntz, q double").parquet(str(tmp_path / "f")), "made", "1 day")
    right = inc.timed(spark.readStream.schema("key int, at timestamp_ntz, y double").parquet(str(tmp_path / "a")), "at", "1 day")
    inc.run_available(inc.settled(left, right, ["key"], "made", "at", "2 HOURS"), str(tmp_path / "c"), name="settled")
    want = sorted((q, y) for k, m, q in f for j, t, y in a if j == k and 0 <= (t - m).total_seconds() <= 7200)
    assert sorted((r.q, r.y) for r in spark.table("settled").collect()) == want and len(want) == 12


def test_unsettled_chunks(spark):
    desired = spark.createDataFrame([("a",), ("b",), ("c",)], "_chunk string")
    manifest = spark.createDataFrame([("a", True), ("b", False)], "_chunk string, settled boolean")
    assert sorted(r[0] for r in inc.unsettled(desired, manifest).collect()) == ["b", "c"]
