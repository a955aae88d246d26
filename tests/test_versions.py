"""Versioned tables: what readers see, what writers write, and what a write that dies leaves."""

import glob
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions
from tidemark.sources.versions import HistoryLog, KeyedTable, RowLog, VersionConflict, Versions, current, publish, read_chunks, write_chunks
from tidemark.streaming import incremental as inc


def _bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True))


def test_chunks_switch_in_one_step(spark, tmp_path):
    path, kind = f"file://{tmp_path}/t", "v int, _chunk string"
    df = spark.createDataFrame([(k, f"c{k % 4}") for k in range(40)], kind)
    assert read_chunks(spark, path, df.schema).count() == 0
    write_chunks(df, path)
    before = read_chunks(spark, path, df.schema)
    files = set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    write_chunks(spark.createDataFrame([(100, "c1"), (101, "c9")], kind), path, fetched=["c2", "c7"])
    after = sorted(map(tuple, read_chunks(spark, path, df.schema).collect()))
    assert after == sorted([(k, f"c{k % 4}") for k in range(40) if k % 4 in (0, 3)] + [(100, "c1"), (101, "c9")])
    # a reader that has begun keeps its version, and nothing of it has been copied or deleted
    assert before.count() == 40 and files <= set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    assert read_chunks(spark, path, df.schema, version=1).count() == 40


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, _chunk string")
    write_chunks(df, path)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versions, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        write_chunks(df.withColumn("v", F.col("v") * 10), path)
    monkeypatch.undo()
    assert sorted(r.v for r in read_chunks(spark, path, df.schema).collect()) == [1, 2]
    table = Versions(spark, path)
    assert len(table.loads()) == 2 and table.cleaned(1) == 1 and len(table.loads()) == 1
    assert sorted(r.v for r in read_chunks(spark, path, df.schema).collect()) == [1, 2]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    assert table.latest() == 0 and table.commit(0, []) == 1
    with pytest.raises(VersionConflict):
        table.commit(0, [])
    assert table.latest() == 1


def test_publish_replaces_all(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumnRenamed("id", "v")
    assert current(spark, path, df.schema).count() == 0
    publish(df, path)
    publish(current(spark, path, df.schema).filter("v > 6"), path)
    assert current(spark, path, df.schema).count() == 3 and current(spark, path, df.schema, version=1).count() == 10


def _table(spark, tmp_path, **more):
    schema = spark.createDataFrame([], "k int, s string, at int, v string").schema
    return KeyedTable(spark, f"file://{tmp_path}/t", schema, ["k", "s"], ["at", "v"], buckets=8, **more)


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    table = _table(spark, tmp_path)
    rows = [(k, "x" * (k % 3), 1, "old") for k in range(400)]
    table.upsert(spark.createDataFrame(rows, table.schema))
    names = lambda: {e.part: e.load for e in table.entries(table.latest())}
    first, size = names(), _bytes(f"{tmp_path}/t")
    fresh = [(5, "xx", 2, "new"), (5, "xx", 2, "older"), (7, "x", 0, "stale"), (1000, "", 1, "more")]
    df = spark.createDataFrame(fresh, table.schema)
    plan, touched, name = table.merge_plan(df, table.entries(table.latest()))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")
    # one side is shuffled and that is the new one: nothing lies between the scan of stored rows and the join but its sort
    final = text.split("== Initial Plan ==")[0]
    scans = [i for i, line in enumerate(final.splitlines()) if "FileScan parquet" in line and "Bucketed: true" in line]
    assert len(scans) == 1
    above = final.splitlines()[: scans[0]]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[join:]) and len(touched) <= 3
    table.upsert(df)
    second = names()
    assert {p for p in first if first[p] != second[p]} <= set(touched) and _bytes(f"{tmp_path}/t") < 2 * size
    want = {(k, s): (at, v) for k, s, at, v in rows} | {(5, "xx"): (2, "older"), (1000, ""): (1, "more")}
    assert {(r.k, r.s): (r.at, r.v) for r in table.read().collect()} == want
    # every bucket is one file in order of its keys
    for part, load in second.items():
        (f,) = glob.glob(f"{tmp_path}/t/data/load={load}/_bucket={part}/*.parquet")
        keys = [(r.k, r.s) for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, "a", 1, "v")], table.schema))


@pytest.mark.parametrize("by_batch", [False, True])
def test_batches_count_once_and_cost_what_they_bring(spark, tmp_path, by_batch):
    table = _table(spark, tmp_path, by_batch=by_batch)
    rnd, want = random.Random(3), {}
    for number in range(7):
        rows = list({(rnd.randrange(60), "a", rnd.randrange(9), f"{number}-{j}") for j in range(40)})
        before = _bytes(f"{tmp_path}/t") if number else 0
        assert table.append(spark.createDataFrame(rows, table.schema).coalesce(1), number)
        assert _bytes(f"{tmp_path}/t") - before < 3000
        assert not table.append(spark.createDataFrame([(1, "a", 99, "again")], table.schema), number)
        new = {}
        for k, s, at, v in rows:
            new[k, s] = max(new.get((k, s), (-1, "")), (at, v))
        want = want | (new if by_batch else {k: max(v, want.get(k, (-1, ""))) for k, v in new.items()})
        if number % 3 == 2:
            table.compact()
        assert {(r.k, r.s): (r.at, r.v) for r in table.read().collect()} == want
    assert sum(e.kind == "delta" for e in table.entries(table.latest())) == 1
    assert not table.append(spark.createDataFrame([(1, "a", 99, "again")], table.schema), 2)


def test_a_batch_that_dies_is_taken_again(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path)
    table.append(spark.createDataFrame([(1, "a", 1, "x")], table.schema), 0)
    real = Versions.commit

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versions, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        table.append(spark.createDataFrame([(1, "a", 2, "y")], table.schema), 1)
    monkeypatch.setattr(Versions, "commit", real)
    assert [r.v for r in table.read().collect()] == ["x"]
    assert table.append(spark.createDataFrame([(1, "a", 2, "y")], table.schema), 1) and [r.v for r in table.read().collect()] == ["y"]


def test_history_reads_revisions_in_order(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, state string, at timestamp_ntz").schema
    log = HistoryLog(spark, f"file://{tmp_path}/h", schema, ["k"], ["state"], ["at"], buckets=4)
    t0, rnd, rows = datetime(2024, 1, 1), random.Random(1), []
    for number in range(5):
        batch = [(rnd.randrange(6), rnd.choice(["a", "b", None]), t0 + timedelta(minutes=len(rows) * 17 + j if number % 2 else rnd.randrange(10**6))) for j in range(30)]
        batch = list({(k, at): (k, s, at) for k, s, at in batch if (k, at) not in {(x, z) for x, _, z in rows}}.values())
        log.append(spark.createDataFrame(batch, schema), number)
        rows += batch
        if number in (1, 3):
            log.compact()
    want = []
    for k in range(6):
        changes = []
        for _, s, at in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            if not changes or changes[-1][0] != s:
                changes.append((s, at))
        want += [(k, s, at, changes[i + 1][1] if i + 1 < len(changes) else None) for i, (s, at) in enumerate(changes)]
    assert sorted(map(tuple, log.read().collect()), key=str) == sorted(want, key=str)
    last = {k: max((r for r in rows if r[0] == k), key=lambda r: r[2]) for k in range(6)}
    assert {r.k: tuple(r) for r in log.state().collect()} == last


def test_late_rows_go_aside(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, ts timestamp_ntz").schema
    sink = inc.chunked_sink(str(tmp_path), schema, "ts", "2 DAYS")
    day = lambda k: datetime(2024, 1, k, 12)
    batches = [[(1, day(1)), (2, day(2))], [(3, day(5))], [(4, day(1)), (5, day(4)), (6, day(1))], [(7, day(2)), (8, day(7))]]
    for number, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), number)
        sink(spark.createDataFrame(rows, schema), number)
    main, late, state = inc.chunked_tables(spark, str(tmp_path), schema)
    assert sorted(r.id for r in main.read().collect()) == [1, 2, 3, 5, 8] and sorted(r.id for r in late.read().collect()) == [4, 6, 7]
    # the fourth is over by two days when the seventh is half through
    assert {r["_chunk"]: r.settled for r in state.read().collect()} == {date(2024, 1, k): k in (1, 2, 4) for k in (1, 2, 4, 5, 7)}
    open_ = inc.unsettled(state.read().select("_chunk"), state.read())
    assert sorted(r["_chunk"].day for r in open_.collect()) == [5, 7]


def test_row_log_keeps_every_row(spark, tmp_path):
    log = RowLog(spark, str(tmp_path / "l"), spark.createDataFrame([], "v int").schema)
    for k in range(3):
        log.append(spark.createDataFrame([(k,), (k,)], "v int"), k)
        log.append(spark.createDataFrame([(9,)], "v int"), k)
    assert sorted(r.v for r in log.read().collect()) == [0, 0, 1, 1, 2, 2] and versions.Entry("seen", "", "", 2) in log.entries(3)
