"""Queries on time and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeutil as t
from tidemark.operators.mart import first_known
from tidemark.plans.registry import ZONE, query, read, rounded


@query("""SELECT event_id,
 CASE WHEN s >= TIMESTAMP '2024-03-31 01:00:00' AND s < TIMESTAMP '2024-03-31 02:00:00' THEN TIMESTAMP '2024-03-31 01:00:00'
  WHEN s < TIMESTAMP '2024-03-31 01:00:00' THEN s ELSE s - INTERVAL 1 HOUR END AS spring_utc,
 CASE WHEN a < TIMESTAMP '2024-10-27 01:00:00' THEN a - INTERVAL 1 HOUR ELSE a END AS autumn_utc
FROM (SELECT event_id, ts + INTERVAL 75 DAY AS s, ts + INTERVAL 290 DAY AS a FROM events)""")
def clock_changes_to_utc(spark, d):
    """H2, H4: wall clocks around both clock changes as UTC; the gap ends at 01:00 UTC, the repeated hour is the later one."""
    ev = read(spark, d, "events")
    local = lambda days: F.col("ts") + F.expr(f"INTERVAL {days} DAY")
    return ev.select("event_id", t.to_utc(local(75), ZONE).alias("spring_utc"), t.to_utc(local(290), ZONE).alias("autumn_utc"))


@query("""SELECT event_id, date_trunc('hour', ts) AS hour_utc, round(epoch(date_trunc('second', ts) - date_trunc('day', ts)) / 60.0, 6) AS minutes,
 CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 1 DAY END AS newest,
 CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) >= 16 AND hour(ts) < 20 THEN 'peak' ELSE 'other' END AS hours,
 strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS parsed, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type END AS DOUBLE) AS number,
 CAST(year(ts) AS BIGINT) AS archive, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS padded, day(ts + INTERVAL 1 DAY) = 1 AS rolls_over,
 round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN 2 * value END, 0), 6) AS fallback, CAST(ts AS DATE) + 1 AS tomorrow FROM events""", "tomorrow")
def clock_parts(spark, d):
    """H5, H6, H11, H16, H21 to H24, H26."""
    ev = read(spark, d, "events")
    groups = {"night": (0, 6), "morning": (6, 12), "peak": (16, 20)}
    k = F.get_json_object("props", "$.k")
    out = ev.select(
        "event_id",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_utc"),
        t.minutes_between("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).cast("double").alias("minutes"),
        t.newest(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("newest"),
        t.hour_group(F.hour("ts"), groups).alias("hours"),
        t.format_iso("ts").alias("iso"),
        t.parse_iso(t.format_iso("ts")).alias("parsed"),
        F.when(F.col("event_id") % 2 == 0, k).otherwise(F.col("event_type")).try_cast("double").alias("number"),
        t.archive_year(F.concat(F.lit("prices-"), F.year("ts").cast("string"), F.lit(".zip"))).alias("archive"),
        F.lpad(F.hour("ts").cast("string"), 2, "0").alias("padded"),
        t.month_rolls_over("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("rolls_over"),
        first_known(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.when(F.col("event_id") % 3 == 1, 2 * F.col("value")), 0.0).alias("fallback"),
        t.tomorrow("ts", ZONE).alias("tomorrow"),
    )
    return rounded(out)


@query("""WITH s AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
c AS (SELECT CAST(g AS DATE) AS chunk_start, least(CAST(g AS DATE) + 29, b) AS chunk_end FROM (SELECT b, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 30 DAY)) AS g FROM s))
SELECT chunk_start, chunk_end, count(o_orderkey) AS n FROM c LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN chunk_start AND chunk_end GROUP BY ALL""", "chunk_start", "chunk_end")
def date_chunk_counts(spark, d):
    """Orders per consecutive chunk of 30 days from the first order on."""
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    s = o.agg(F.min("day").cast("string").alias("a"), F.max("day").cast("string").alias("b")).first()
    chunks = t.date_chunks(spark, s.a, s.b, 30)
    per = o.withColumn("chunk_start", F.date_add(F.lit(s.a).cast("date"), (F.floor(F.date_diff("day", F.lit(s.a).cast("date")) / 30) * 30).cast("int"))).groupBy("chunk_start").agg(F.count("o_orderkey").alias("n"))
    return chunks.join(per, "chunk_start", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, s[1] AS p10, s[2] AS p50, s[3] AS p90 FROM (SELECT *, list_sort([round(l_discount, 6), round(l_tax, 6), round(l_quantity / 500, 6)]) AS s FROM lineitem)""")
def quantiles_in_order(spark, d):
    """Three quantiles of a row that may cross, in order."""
    names = [t.quantile_name(q) for q in (0.1, 0.5, 0.9)]
    li = rounded(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("p10"), F.col("l_tax").alias("p50"), (F.col("l_quantity") / 500).alias("p90")))
    return li.withColumns(t.sorted_row(names))


@query("""WITH u AS (SELECT event_id, unnest([75, 181, 290]) AS days, ts FROM events), l AS (SELECT event_id, days, ts + to_days(days) AS u, CAST(timezone('Europe/London', timezone('UTC', ts + to_days(days))) AS DATE) AS day FROM u)
SELECT event_id, CAST(days AS BIGINT) AS days, day, CAST(floor(epoch(u - timezone('UTC', timezone('Europe/London', CAST(day AS TIMESTAMP)))) / 1800) + 1 AS BIGINT) AS period, day + 1 AS tomorrow FROM l""", "day", "tomorrow")
def settlement_periods(spark, d):
    """Local day, number of the half-hour in it and the day after, for instants around both clock changes and in summer."""
    ev = read(spark, d, "events").select("event_id", "ts", F.explode(F.array(*[F.lit(k) for k in (75, 181, 290)])).alias("days"))
    at = F.timestamp_add("DAY", F.col("days"), F.col("ts"))
    out = ev.select("event_id", "days", t.settlement_day(at, ZONE).alias("day"), t.settlement_period(at, ZONE).alias("period"), t.tomorrow(at, ZONE).alias("tomorrow"))
    return rounded(out)
