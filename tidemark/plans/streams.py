"""Queries that run as streams over `events` in several batches and are held against batch SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeutil as t
from tidemark.plans.registry import ZONE, query, read, rounded
from tidemark.sources.staging import fresh_folder
from tidemark.sources.versions import HistoryLog
from tidemark.streaming import incremental as inc


def shared(spark: SparkSession) -> str:
    return fresh_folder(spark, "query")


#: Arrivals into which the queries deal `events`: by time, but every tenth event comes with the last.
ARRIVALS = 5


def _arrival(n: int = ARRIVALS) -> Column:
    in_order = F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(n - 2))
    return F.when(F.col("event_id") % 10 == 0, n - 1).otherwise(in_order)


def _arriving(rows: DataFrame, path: str, run, arrival: Column | None = None, n: int = ARRIVALS) -> None:
    """Lays each arrival into a folder and has `run` read what is new there, from the stream that is given to it."""
    arrival = _arrival() if arrival is None else arrival
    for k in range(n):
        rows.filter(arrival == k).write.mode("append").parquet(f"{path}/in")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{path}/in"))


def _drained(rows: DataFrame, of, mode: str, arrival: Column | None = None) -> DataFrame:
    """What the stream of(...) over rows has written once all arrivals are read: the last batch in mode complete, else all batches."""
    spark, path, schema = rows.sparkSession, shared(rows.sparkSession), []

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else number}")

    def run(stream):
        out = of(stream)
        schema[:] = [out.schema]
        inc.run_available(out, f"{path}/checkpoint", sink=sink, mode=mode)

    _arriving(rows, path, run, arrival)
    return spark.read.schema(schema[0]).parquet(f"{path}/out").select(*schema[0].names)


def _kept(table, rows: DataFrame, path: str, prepare=None, every: int = 2):
    """The table after all arrivals of rows have come in; every second batch is merged into its buckets."""
    sink = inc.keyed_sink(table, every, prepare=prepare)
    _arriving(rows, path, lambda stream: inc.run_available(stream, f"{path}/checkpoint", sink=sink))
    return table.read()


@query("""SELECT date_trunc('hour', ts) + to_minutes(CAST(30 * (minute(ts) // 30) AS BIGINT)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_grid(spark, d):
    """Half-hour windows by type."""
    out = _drained(read(spark, d, "events"), lambda s: inc.grid(inc.timed(s, "ts", "1 day"), "ts", "value", "30 minutes", ["event_type"]), "complete")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL""")
def stream_latest(spark, d):
    """Latest delivery of each key; early ones among those that come last change nothing."""
    rows, path = read(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), shared(spark)
    return _kept(inc.latest_delivery(spark, f"{path}/table", rows.schema, ["user_id", "event_type"], "ts"), rows, path)


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 4 ELSE least((day(ts) - 1) // 7, 3) END AS batch FROM events)
SELECT user_id, arg_max(event_id, (batch, ts, event_id)) AS event_id, arg_max(event_type, (batch, ts, event_id)) AS event_type, arg_max(ts, (batch, ts, event_id)) AS ts FROM e GROUP BY 1""")
def stream_last_written(spark, d):
    """The row of the latest batch of each key; batches are appended once and merged into buckets now and then."""
    rows, path = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), shared(spark)
    return _kept(inc.last_written(spark, f"{path}/table", rows.schema, ["user_id"], ["ts", "event_id"]), rows, path)


@query("""WITH days AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events),
x AS (SELECT user_id, day, value, ts AS issued_at, e.event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, e.event_id DESC) AS rn
  FROM days JOIN events e ON event_type = 'purchase' AND user_id % 4 = dayofyear(day) % 4 AND ts <= CAST(day AS TIMESTAMP) - INTERVAL 15 HOUR)
SELECT user_id, day, round(value, 6) AS value, issued_at, event_id FROM x WHERE rn = 1""", "day")
def stream_vintages(spark, d):
    """The newest purchase known by the cutoff of each of a user's target days, kept up to date as purchases come in."""
    ev = read(spark, d, "events")
    days = ev.agg(F.explode(F.sequence(F.min("ts").cast("date"), F.max("ts").cast("date"))).alias("day")).withColumn("cutoff_utc", t.cutoff_utc("day", ZONE))
    users = ev.filter("event_type = 'purchase'").select("user_id").distinct()
    spine = users.join(days, F.col("user_id") % 4 == F.dayofyear("day") % 4)
    rows, path = ev.filter("event_type = 'purchase'").select("user_id", "value", F.col("ts").alias("issued_at"), "event_id", "ts"), shared(spark)
    table, fresh = inc.newest_vintages(spine.select("user_id", "day", "cutoff_utc"), f"{path}/table", ["user_id"], ["value"], "issued_at", ["event_id"], schema=rows.schema)
    out = _kept(table, rows, path, prepare=fresh).join(days, "cutoff_utc")
    return rounded(out.select("user_id", "day", "value", "issued_at", "event_id"))


@query("""SELECT f.event_id, f.user_id, f.ts AS made_at, a.event_id AS actual_id, a.ts AS actual_at, round(a.value, 6) AS actual FROM events f JOIN events a
  ON f.event_type = 'view' AND a.event_type = 'purchase' AND a.user_id = f.user_id AND a.ts >= f.ts AND a.ts <= f.ts + INTERVAL 6 HOUR""")
def stream_settled(spark, d):
    """I4: a view settles when the user buys within six hours; both streams come in by time."""
    ev = read(spark, d, "events")
    both = ev.select("event_id", "user_id", "event_type", "value", "ts")

    def of(stream):
        f = inc.timed(stream.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("made_at")), "made_at", "2 days")
        a = inc.timed(stream.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("actual_id"), F.col("ts").alias("actual_at"), F.col("value").alias("actual")), "actual_at", "2 days")
        return inc.settled(f, a, ["user_id"], "made_at", "actual_at", "6 HOURS")

    out = _drained(both, of, "append", F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(ARRIVALS - 1)))
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("made_at", "actual_at")}))


@query("""WITH n AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NULL OR before <> event_type)
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM n""")
def stream_history(spark, d):
    """Every revision of a user's state over five batches, the last of which brings earlier ones."""
    rows, path = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), shared(spark)
    return _kept(HistoryLog(spark, f"{path}/table", rows.schema, ["user_id"], ["event_type"], ["ts", "event_id"]), rows, path)


_LATE = """e AS (SELECT *, CAST(ts AS DATE) AS chunk, CASE WHEN event_id % 10 < 2 THEN 2 + event_id % 10 WHEN day(ts) <= 12 THEN 0 ELSE 1 END AS batch FROM events),
tops AS (SELECT batch + 1 AS batch, max(max(ts)) OVER (ORDER BY batch) AS top FROM e GROUP BY batch), firsts AS (SELECT chunk, min(batch) AS first FROM e GROUP BY 1),
k AS (SELECT e.*, coalesce(first < e.batch AND CAST(e.chunk AS TIMESTAMP) + INTERVAL 4 DAY <= top, false) AS late FROM e JOIN firsts USING (chunk) LEFT JOIN tops USING (batch))"""


@query(f"""WITH {_LATE} SELECT chunk, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late, round(coalesce(sum(value) FILTER (late), 0), 4) AS late_total, CAST(chunk AS TIMESTAMP) + INTERVAL 4 DAY <= (SELECT max(ts) FROM e) AS settled FROM k GROUP BY 1""", "chunk")
def stream_late_chunks(spark, d):
    """Days and what came in time, what came after the day was settled (two of four batches are late), and which days are open still."""
    rows, path = read(spark, d, "events").select("event_id", "value", "ts"), shared(spark)
    arrival = F.when(F.col("event_id") % 10 < 2, 2 + F.col("event_id") % 10).when(F.dayofmonth("ts") <= 12, 0).otherwise(1)
    sink = inc.chunked_sink(path, rows.schema, "ts", "3 DAYS")
    _arriving(rows, path, lambda stream: inc.run_available(stream, f"{path}/checkpoint", sink=sink), arrival, 4)
    main, late, state = inc.chunked_tables(spark, path, rows.schema)
    a = main.read().groupBy("_chunk").agg(F.count("*").alias("n"))
    b = late.read().groupBy("_chunk").agg(F.count("*").alias("n_late"), F.sum("value").alias("late_total"))
    out = state.read().select("_chunk", "settled").join(a, "_chunk", "left").join(b, "_chunk", "left").na.fill(0)
    open_ = inc.unsettled(out.select("_chunk"), state.read()).withColumn("_open", F.lit(True))
    out = out.join(open_, "_chunk", "left").withColumn("settled", F.col("_open").isNull()).drop("_open")
    return rounded(out.withColumnRenamed("_chunk", "chunk"), 4)


@query("""SELECT CAST(g AS TIMESTAMP) AS cutoff, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high
FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE) + INTERVAL 9 HOUR, CAST(max(ts) AS DATE) + INTERVAL 177 HOUR, INTERVAL 1 DAY)) AS g FROM events) JOIN events ON ts <= g AND ts > g - INTERVAL 7 DAY GROUP BY 1""")
def stream_trailing(spark, d):
    """I8: stats of the seven days up to each nine o'clock."""
    out = inc.trailing_from_panes(_drained(read(spark, d, "events"), lambda s: inc.pane_stats(s, "ts", "value"), "complete"))
    return rounded(out.withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz")))


@query("""WITH x AS (SELECT date_trunc('day', ts) AS day, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1) SELECT * FROM x WHERE n >= 0.9 * 300""")
def stream_complete_days(spark, d):
    """Days with nine tenths of the expected rows."""
    out = _drained(read(spark, d, "events"), lambda s: inc.complete_days(inc.timed(s, "ts", "1 day"), "ts", "value", 300), "complete")
    return rounded(out.withColumn("day", F.col("day").cast("timestamp_ntz")), 4)


@query("""SELECT event_type, max(ts) AS last_seen FROM events GROUP BY 1""")
def stream_last_seen(spark, d):
    """I9."""
    out = _drained(read(spark, d, "events"), lambda s: inc.last_seen(inc.timed(s, "ts", "1 day"), "ts", "event_type"), "complete")
    return out.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
