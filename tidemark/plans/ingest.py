"""Queries that write to the shared folder and read back: payloads, lake, sinks, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import timeutil as t
from tidemark.operators.calendar import settlement_calendar
from tidemark.plans.registry import ZONE, query, r, read, rounded
from tidemark.sources import lake, normalise
from tidemark.sources.staging import fresh_folder
from tidemark.sources.versions import KeyedTable, current, publish, read_chunks, write_chunks


def _archive(payload: DataFrame, body: Column, path: str) -> None:
    """A3: each response as a gzipped JSON file, as a fetcher leaves them."""
    payload.select("chunk", F.to_json(body).alias("value")).write.partitionBy("chunk").option("compression", "gzip").text(path)


#: Records of a response, about.
PAGE = 5_000


def _pages(ev: DataFrame) -> Column:
    """Names the response that a row of events is in: its day and a page of it, of which there are more where days have more rows."""
    s = ev.agg(F.count("*").alias("n"), F.countDistinct(F.col("ts").cast("date")).alias("days")).first()
    page = F.pmod(F.xxhash64("event_id"), F.lit(1 + s.n // max(1, s.days) // PAGE))
    return F.concat_ws("-", F.date_format("ts", "yyyyMMdd"), page.cast("string")).alias("chunk")


def _responses(ev: DataFrame, *gathered: Column) -> DataFrame:
    return ev.groupBy(_pages(ev)).agg(*gathered)


#: Per dataset: kind of event, fields of a record in the payload, and what becomes of them.
RECORDS = {
    "price": ("purchase", {"startTime": "iso", "publishTime": "later", "price": "text", "volume": "number", "provider": "user", "period": "slot"}),
    "demand": ("click", {"startTime": "iso", "publishTime": "later", "price": "number", "volume": "number", "provider": "user", "period": "slot"}),
    "fuel": ("view", {"startTime": "iso", "publishTime": "later", "price": "number", "volume": "text", "provider": "user", "period": "slot"}),
    "demand_forecast": ("error", {"startTime": "iso", "publishTime": "later", "price": "number", "volume": "number", "provider": "user", "period": "slot"}),
    "wind_forecast": ("signup", {"startTime": "iso", "publishTime": "later", "price": "number"}),
}
_FIELDS = {"start_time": ("startTime", "iso"), "published_at": ("publishTime", "iso"), "price": ("price", "double"), "volume": ("volume", "double"), "provider": ("provider", "string"), "period": ("period", "double")}


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'price' WHEN 'click' THEN 'demand' WHEN 'view' THEN 'fuel' WHEN 'error' THEN 'demand_forecast' WHEN 'signup' THEN 'wind_forecast' END AS dataset FROM events)
SELECT dataset, date_trunc('second', ts) AS start_time, date_trunc('second', ts) + INTERVAL 2 HOUR AS published_at, round(value, 6) AS price, CASE WHEN dataset <> 'wind_forecast' THEN round(2 * value, 6) END AS volume,
 CASE WHEN dataset <> 'wind_forecast' THEN 'u' || user_id END AS provider, CASE WHEN dataset <> 'wind_forecast' THEN CAST(hour(ts) * 2 + minute(ts) // 30 + 1 AS DOUBLE) END AS period FROM e WHERE dataset IS NOT NULL""")
def normalised_records(spark, d):
    """Five datasets as gzipped responses, read again from the archive and made typed rows."""
    ev, path, out = read(spark, d, "events"), fresh_folder(spark, "archive"), None
    made = {"iso": t.format_iso("ts"), "later": t.format_iso(F.col("ts") + F.expr("INTERVAL 2 HOUR")), "text": F.col("value").cast("string"), "number": F.col("value"), "user": F.concat(F.lit("u"), "user_id"), "slot": t.half_hour_slot("ts") + 1}
    for name, (kind, fields) in RECORDS.items():
        double = lambda f, how: (F.col("value") * 2).cast("string" if how == "text" else "double") if f == "volume" else made[how]
        record = F.struct(*[double(f, how).alias(f) for f, how in fields.items()])
        some = _responses(ev.filter(F.col("event_type") == kind), F.collect_list(record).alias("data"))
        _archive(some, F.struct("data"), f"{path}/{name}")
        text = ", ".join(f"{f}:{'string' if how != 'number' else 'double'}" for f, how in fields.items())
        payload = lake.read_archive(spark, f"{path}/{name}", T.StructType.fromDDL(f"data array<struct<{text}>>"))
        rows = normalise.record_list(payload, "data", {new: (old, how) for new, (old, how) in _FIELDS.items() if old in fields})
        rows = rows.withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return rounded(out)


@query("""SELECT event_id, ts + INTERVAL 181 DAY - to_seconds(CAST(second(ts) AS BIGINT)) - to_microseconds(CAST(microsecond(ts) % 1000000 AS BIGINT)) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS issued_at,
 CASE WHEN event_id % 2 = 0 THEN 'utc' ELSE 'local' END AS basis, CAST(CAST(ts AS DATE) + 182 AS TIMESTAMP) + to_hours(CAST(user_id % 24 AS BIGINT)) - INTERVAL 90 MINUTE AS start_utc,
 CASE WHEN event_id % 7 > 0 THEN round(value, 6) END AS solar FROM events WHERE event_id % 11 > 0""")
def embedded_vintages(spark, d):
    """Vintages in two formats told apart by their clock, on summer dates, when the zone is an hour ahead; rows without issue time are dropped."""
    ev = read(spark, d, "events").withColumn("at", F.date_trunc("minute", F.timestamp_add("DAY", F.lit(181), F.col("ts"))).cast("timestamp_ntz"))
    short = F.col("event_id") % 2 == 0
    clock = F.date_format("at", "HH:mm")
    raw = ev.select(
        "event_id",
        F.when(F.col("event_id") % 11 > 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm")).otherwise("?").alias("issued"),
        F.when(short, clock).otherwise(F.concat(clock, F.lit(":00"))).alias("clock"),
        F.date_format(F.date_add(F.col("ts").cast("date"), 182), "yyyy-MM-dd").alias("day"),
        F.concat((F.col("user_id") % 24).cast("string"), F.lit(":00")).alias("ends"),
        F.when(F.col("event_id") % 7 > 0, F.col("value").cast("string")).otherwise("-").alias("solar"),
        F.col("event_id").cast("string").alias("id"),
    )
    out = normalise.embedded_forecasts(raw, "issued", "clock", "day", "ends", {"solar": "solar", "id": "id"}, ZONE)
    return rounded(out.withColumn("event_id", F.col("id").cast("long")).select("event_id", "issued_at", "basis", "start_utc", "solar"))


@query("""WITH e AS (SELECT user_id % 3 AS loc, date_trunc('second', ts) AS t0, value AS v, event_id FROM events),
l AS (SELECT loc, t0, v, event_id, unnest([1, 2]) AS lead FROM e)
SELECT 'l' || loc AS location_id, CAST(lead AS BIGINT) AS lead_days, t0 AS valid_time, round(CASE WHEN lead = 1 THEN v ELSE 2 * v END, 6) AS wind, t0 - to_days(CAST(lead AS INTEGER)) + INTERVAL 6 HOUR AS available_at
FROM l WHERE v IS NOT NULL AND (lead = 1 AND event_id % 2 = 0 OR lead = 2 AND event_id % 3 > 0)""")
def weather_vintages(spark, d):
    """A10, A3: parallel arrays per location and lead out of archived responses; times without any value are dropped."""
    ev, path = read(spark, d, "events"), fresh_folder(spark, "archive")
    at = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 > 0, F.col("value") * 2).alias("b"))
    per = ev.groupBy(_pages(ev), F.concat(F.lit("l"), F.col("user_id") % 3).alias("loc")).agg(F.collect_list(at).alias("at"))
    hourly = F.struct(F.col("at.time").alias("time"), F.col("at.a").alias("wind_previous_day1"), F.col("at.b").alias("wind_previous_day2"))
    per = per.groupBy("chunk").agg(F.collect_list(F.struct("loc", F.struct(hourly.alias("hourly")).alias("resp"))).alias("x"))
    # keys of null values stay in the text, so that arrays keep their lengths
    _archive(per, F.struct(F.lit("m").alias("model"), F.col("x.loc").alias("location_ids"), F.col("x.resp").alias("responses")), path)
    kind = "model string, location_ids array<string>, responses array<struct<hourly:struct<time:array<string>,wind_previous_day1:array<double>,wind_previous_day2:array<double>>>>"
    out = normalise.parallel_arrays(lake.read_archive(spark, path, T.StructType.fromDDL(kind)), ["wind"], [1, 2])
    return rounded(out.drop("model"))


@query("""SELECT date_trunc('minute', ts) AS start_time, date_trunc('minute', ts) + INTERVAL 30 MINUTE AS end_time, CASE WHEN event_id % 5 > 0 THEN round(value, 6) END AS intensity_forecast, CASE WHEN event_id % 3 > 0 THEN round(value + 1, 6) END AS intensity_actual, event_type AS intensity_index FROM events""")
def carbon_intensity(spark, d):
    """Nested records flattened; what is no number is null."""
    ev, path = read(spark, d, "events"), fresh_folder(spark, "archive")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")
    number = F.struct(
        F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string")).otherwise("n/a").alias("forecast"),
        F.when(F.col("event_id") % 3 > 0, (F.col("value") + 1).cast("string")).otherwise("").alias("actual"),
        F.col("event_type").alias("index"),
    )
    record = F.struct(iso("ts").alias("from"), iso(F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("to"), number.alias("intensity"))
    _archive(_responses(ev, F.collect_list(record).alias("data")), F.struct("data"), path)
    kind = "data array<struct<`from`:string,`to`:string,intensity:struct<forecast:string,actual:string,index:string>>>"
    return rounded(normalise.nested_intensity(lake.read_archive(spark, path, T.StructType.fromDDL(kind))))


@query("""SELECT 'events/' || event_type AS dataset, strftime(ts, '%Y%m%d') AS _chunk, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL""")
def lake_datasets(spark, d):
    """Datasets of one source chosen by pattern, each scanned from its folders with a declared schema."""
    ev, root = read(spark, d, "events").select("event_type", "event_id", "value", "ts"), fresh_folder(spark, "lake")
    stamped = lake.stamped(ev, F.date_format("ts", "yyyyMMdd"), "2024-02-01 00:00:00")
    kinds = ["click", "view", "purchase"]
    for kind in kinds:
        stamped.filter(F.col("event_type") == kind).drop("event_type").write.partitionBy("_chunk").parquet(f"{root}/events/{kind}")
    catalogue = [f"events/{k}" for k in kinds] + ["orders/all"]
    schema, out = T.StructType.fromDDL("event_id bigint, value double, ts timestamp_ntz, _ingested_at timestamp_ntz, _chunk string"), None
    for name in lake.select_datasets(catalogue, "events"):
        rows = lake.read_lake(spark, root, name, schema).withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("dataset", "_chunk").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("""WITH e AS (SELECT event_id, value, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, round(CASE WHEN day(day) % 4 = 1 THEN 10 * value ELSE value END, 6) AS value, strftime(day, '%Y%m%d') AS _chunk FROM e WHERE day(day) % 4 <> 2 AND (day(day) % 4 <> 1 OR event_id % 2 = 1)""")
def replaced_chunks(spark, d):
    """Days of a chunked table; some are replaced, some fetched again without rows and so gone, all in one step; the others are not written again."""
    ev, path = read(spark, d, "events"), fresh_folder(spark, "chunks")
    rows = ev.select("event_id", "value", F.date_format("ts", "yyyyMMdd").alias("_chunk"), (F.dayofmonth("ts") % 4).alias("k"))
    write_chunks(rows.drop("k"), path)
    gone = [x[0] for x in rows.filter("k = 2").select("_chunk").distinct().collect()]
    again = rows.filter("k = 1 and event_id % 2 = 1").withColumn("value", 10 * F.col("value"))
    write_chunks(again.drop("k"), path, fetched=gone)
    out = read_chunks(spark, path, T.StructType.fromDDL("event_id bigint, value double, _chunk string"))
    return rounded(out)


@query("""SELECT n_nationkey, n_name, coalesce(r_name, 'elsewhere') AS region, count(s_suppkey) AS suppliers FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def seeded_dimension(spark, d):
    """A CSV seed with declared types as dimension of suppliers."""
    from tidemark.operators.mart import with_dimension

    path = fresh_folder(spark, "seed")
    read(spark, d, "region").filter("r_regionkey <> 2").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    seed = lake.read_seed(spark, path, T.StructType.fromDDL("r_regionkey bigint, r_name string"))
    nations = with_dimension(read(spark, d, "nation"), seed, {"n_regionkey": "r_regionkey"}, {"r_name": "elsewhere"})
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("suppliers"))
    return rounded(nations.join(s, "n_nationkey", "left").select("n_nationkey", "n_name", F.col("r_name").alias("region"), F.coalesce("suppliers", F.lit(0)).alias("suppliers")))


@query("""WITH w AS (SELECT 1 + (day(ts) - 1) // 10 AS part, min(CAST(ts AS DATE)) AS a, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n FROM events GROUP BY 1)
SELECT attempt, outcome, CASE WHEN outcome = 'appended' THEN n ELSE 0 END AS appended FROM w JOIN (SELECT unnest([1, 1, 2, 2, 3]) AS part, unnest([1, 2, 3, 4, 5]) AS attempt, unnest(['appended', 'recorded', 'late', 'appended', 'missing']) AS outcome) USING (part)""")
def recorded_once(spark, d):
    """Forecasts enter the record once, in time and whole: of five attempts two are taken."""
    ev, path = read(spark, d, "events"), fresh_folder(spark, "record")
    rows = ev.select("event_id", F.col("ts").cast("date").alias("day"), (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).alias("part"))
    rows = rows.withColumn("starts", F.col("day").cast("timestamp_ntz"))
    early = (F.to_date(F.lit("2000-01-01"))).cast("timestamp_ntz")
    attempts = [(1, early), (1, early), (2, F.col("starts")), (2, early), (3, F.when(F.col("event_id") % 2 == 0, early))]
    out = None
    for k, (part, made) in enumerate(attempts):
        fresh = rows.filter(F.col("part") == part).withColumn("made", made)
        record = read_chunks(spark, path, T.StructType.fromDDL("event_id bigint, day date, _chunk string")) if k else None
        taken, outcome = lake.append_once(record, fresh, "day", "made", "starts")
        if outcome == "appended":
            write_chunks(taken.select("event_id", "day", F.date_format("day", "yyyyMMdd").alias("_chunk")), path)
        one = taken.agg(F.lit(k + 1).cast("long").alias("attempt"), F.lit(outcome).alias("outcome"), F.count("*").alias("appended"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_trunc('second', o_orderdate) + INTERVAL 90 MINUTE AS at, round(o_totalprice / 7, 4) AS share, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status FROM orders""", "day")
def formatted_round_trip(spark, d):
    """Dates, instants and doubles as text in CSV, and typed again."""
    o, path = read(spark, d, "orders"), fresh_folder(spark, "csv")
    rows = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.date_trunc("second", "o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 90 MINUTE")).alias("at"), r(F.col("o_totalprice") / 7, 4).alias("share"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"))
    lake.write_formatted(rows, path)
    return lake.read_formatted(spark, path, rows.schema)


@query("""SELECT version, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([1, 2]) AS version) WHERE version = 2 OR event_id % 2 = 0 GROUP BY ALL""")
def published_totals(spark, d):
    """A mart behind a view, published twice; the first version can still be read."""
    ev, path = read(spark, d, "events"), fresh_folder(spark, "layers")
    total = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))
    layers = lake.layered({"stg_events": ("view", ev.filter("event_id % 2 = 0")), "totals": ("table", total(ev.filter("event_id % 2 = 0")))}, path)
    publish(total(ev), f"{path}/totals")
    schema = layers["totals"].schema
    first, second = current(spark, f"{path}/totals", schema, version=1), current(spark, f"{path}/totals", schema)
    return first.withColumn("version", F.lit(1).cast("long")).unionByName(second.withColumn("version", F.lit(2).cast("long")))


@query("""SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0""")
def sampled_fixture(spark, d):
    """Rows that a predicate picks, sorted and written with zstd, read again."""
    path = fresh_folder(spark, "fixture")
    lake.fixture(read(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path, (F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0))
    return rounded(spark.read.parquet(path))


@query("""WITH l AS (SELECT max(CAST(ts AS DATE)) AS last FROM events)
SELECT strftime(ts, '%Y%m%d') || '-' || strftime(ts, '%Y%m%d') AS _chunk, count(*) AS n, round(sum(value), 4) AS total FROM events, l WHERE CAST(ts AS DATE) >= last - 10 GROUP BY 1""")
def loaded_chunks(spark, d):
    """The chunks of the last ten days, loaded twice; the second load changes nothing."""
    ev, path = read(spark, d, "events").select("event_id", "value", "ts"), fresh_folder(spark, "loaded")
    today = ev.agg(F.max("ts").cast("date").cast("string")).first()[0]
    rows = lake.stamped(ev, t.chunk_key(F.col("ts").cast("date"), 1), "2024-02-01 00:00:00")
    for _ in range(2):
        lake.load(rows, path, today, 10)
    out = read_chunks(spark, path, T.StructType.fromDDL("value double, _chunk string"))
    return out.groupBy("_chunk").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id, epoch_us(ts) AS micros, event_type FROM events""")
def exported_instants(spark, d):
    """Naive UTC timestamps as instants, shown as microseconds since 1970."""
    out = lake.aware(read(spark, d, "events").select("event_id", "ts", "event_type"))
    return out.select("event_id", F.unix_micros("ts").alias("micros"), "event_type")


@query("""SELECT n_name AS name, CAST(strlen(n_comment) + 1 AS BIGINT) AS bytes, sha256(n_comment || chr(10)) AS sha256 FROM (SELECT n_name, n_name || ' of ' || n_regionkey AS n_comment FROM nation)""")
def file_manifest(spark, d):
    """Bytes and SHA-256 of each file of an export."""
    path = fresh_folder(spark, "export")
    n = read(spark, d, "nation").select("n_name", F.concat("n_name", F.lit(" of "), "n_regionkey").alias("value"))
    n.write.partitionBy("n_name").text(path)
    files = lake.manifest(spark, f"{path}/*/part-*")
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", "n_name=([^/]+)/", 1), "\\+", "%2B"))
    return files.select(name.alias("name"), "bytes", "sha256")


@query("""SELECT 'prediction' AS kind, CAST(o_orderkey AS VARCHAR) AS key, round(o_totalprice * 2, 2) AS value FROM orders UNION ALL SELECT 'metric', o_orderstatus, round(avg(o_totalprice), 2) FROM orders GROUP BY o_orderstatus""")
def written_results(spark, d):
    """Predictions as Parquet and metrics as CSV, read again."""
    o, path = read(spark, d, "orders"), fresh_folder(spark, "results")
    predictions = o.select("o_orderkey", r(F.col("o_totalprice") * 2, 2).alias("p50"))
    metrics = o.groupBy("o_orderstatus").agg(r(F.avg("o_totalprice"), 2).alias("mean"))
    lake.write_results(predictions, metrics, path)
    a = spark.read.parquet(f"{path}/predictions").select(F.lit("prediction").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.col("p50").alias("value"))
    b = spark.read.schema("o_orderstatus string, mean double").csv(f"{path}/metrics", header=True)
    return a.unionByName(b.select(F.lit("metric").alias("kind"), F.col("o_orderstatus").alias("key"), F.col("mean").alias("value")))


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS day FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') % 2 = 1), d AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + 5, INTERVAL 1 DAY)) AS DATE) AS day FROM events)
SELECT d.day, h.day IS NOT NULL AS is_holiday, 48 AS periods FROM d LEFT JOIN h ON h.day = d.day""", "day")
def holiday_flags(spark, d):
    """C14: days of a list (here those with an odd number of purchases) flagged on every half-hour of a calendar."""
    ev = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    span = ev.agg(F.min("day").cast("string").alias("a"), F.date_add(F.max("day"), 5).cast("string").alias("b")).first()
    odd = ev.groupBy("day").agg(F.count_if(F.col("event_type") == "purchase").alias("n")).filter("n % 2 = 1")
    cal = settlement_calendar(spark, span.a, span.b, ZONE, holidays=odd.select(F.col("day").alias("holiday_date")))
    return cal.groupBy("day", "is_holiday").agg(F.count("*").alias("periods"))


@query("""SELECT count(*) AS n, count(*) FILTER (ts <= CAST(now() AT TIME ZONE 'UTC' AS TIMESTAMP)) AS passed, max(CAST(ts AS DATE)) <= current_date AS before_today FROM events""")
def passed_by_now(spark, d):
    """H7: what lies before the present moment, in UTC."""
    from tidemark.operators.mart import passed

    ev = read(spark, d, "events")
    n = passed(ev, t.now_utc(), "ts").agg(F.count("*").alias("passed"))
    return ev.agg(F.count("*").alias("n"), (F.max("ts").cast("date") <= t.now_utc().cast("date")).alias("before_today")).crossJoin(F.broadcast(n))


def _orders_table(spark: SparkSession, o: DataFrame) -> KeyedTable:
    return KeyedTable(spark, fresh_folder(spark, "orders"), o.schema, ["o_orderkey"], ["revision", "price"], buckets=16)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS revision, round(CASE WHEN o_orderkey % 4 = 0 THEN 2 * o_totalprice ELSE o_totalprice END, 2) AS price FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 > 0""")
def sorted_upsert(spark, d):
    """Revisions of every fourth order merged into a table in buckets sorted by key; rows of stale revisions change nothing."""
    o = read(spark, d, "orders").select("o_orderkey", F.lit(1).cast("long").alias("revision"), r("o_totalprice", 2).alias("price"))
    table = _orders_table(spark, o)
    table.upsert(o.filter("o_orderkey % 3 > 0"))
    newer = o.filter("o_orderkey % 4 = 0").withColumns({"revision": F.lit(2).cast("long"), "price": r(F.col("price") * 2, 2)})
    stale = o.filter("o_orderkey % 5 = 0 and o_orderkey % 3 > 0").withColumn("revision", F.lit(0).cast("long"))
    table.upsert(newer)
    table.upsert(stale)
    return table.read()
