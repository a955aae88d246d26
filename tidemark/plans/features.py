"""Queries on the feature mart, series and profiles (A24, B, C, D20 to D31, E, F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timeutil as t
from tidemark.operators import asof, mart, panes, series
from tidemark.operators.calendar import settlement_calendar
from tidemark.plans import serve
from tidemark.plans.registry import HALF_HOURS, ZONE, half_hour, half_hours, query, r, read, rounded
from tidemark.sources import lake

HOURS = {"night": (0, 6), "morning": (6, 12), "afternoon": (12, 18), "evening": (18, 24)}


def _spine(spark, d) -> DataFrame:
    """Half-hours of the days of `events` with the cutoff of their day."""
    span = read(spark, d, "events").agg(F.min("ts").cast("date").cast("string").alias("a"), F.max("ts").cast("date").cast("string").alias("b")).first()
    return settlement_calendar(spark, span.a, span.b, ZONE).withColumn("period", F.col("period").cast("long"))


#: The same spine: the zone's clock is UTC in the months of `events`.
_SPINE = """days AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events),
sp AS (SELECT day, CAST(k + 1 AS BIGINT) AS period, CAST(day AS TIMESTAMP) + to_minutes(30 * k) AS start_utc, date_trunc('hour', CAST(day AS TIMESTAMP) + to_minutes(30 * k)) AS hour_utc, CAST(day AS TIMESTAMP) - INTERVAL 15 HOUR AS cutoff_utc
  FROM days, (SELECT unnest(range(48)) AS k))"""


def _lagged(spark, d) -> DataFrame:
    prices = half_hours(spark, d).withColumns({"start_local": t.to_local("start_utc", ZONE), "available_at": F.col("start_utc") + F.expr("INTERVAL 90 MINUTE")})
    out = _spine(spark, d).select("day", "period", "start_utc", "start_local", "cutoff_utc")
    for n in (1, 2, 7):
        out = asof.local_lag_join(out, prices, "price", "available_at", n)
    return out.drop("start_local")


_LAGGED = """lagged AS (SELECT sp.day, sp.period, sp.start_utc, sp.cutoff_utc, a.price AS price_lag_1d, b.price AS price_lag_2d, c.price AS price_lag_7d, a.start_utc + INTERVAL 90 MINUTE AS a1, b.start_utc + INTERVAL 90 MINUTE AS a2, c.start_utc + INTERVAL 90 MINUTE AS a7 FROM sp
  LEFT JOIN hh a ON a.start_utc = sp.start_utc - INTERVAL 1 DAY AND a.start_utc + INTERVAL 90 MINUTE <= cutoff_utc
  LEFT JOIN hh b ON b.start_utc = sp.start_utc - INTERVAL 2 DAY AND b.start_utc + INTERVAL 90 MINUTE <= cutoff_utc
  LEFT JOIN hh c ON c.start_utc = sp.start_utc - INTERVAL 7 DAY AND c.start_utc + INTERVAL 90 MINUTE <= cutoff_utc)"""


@query(f"""WITH {HALF_HOURS}, {_SPINE}, {_LAGGED} SELECT start_utc, cutoff_utc, round(price_lag_1d, 6) AS price_lag_1d, round(price_lag_2d, 6) AS price_lag_2d, round(price_lag_7d, 6) AS price_lag_7d,
 a1 AS price_lag_1d_available_at, a2 AS price_lag_2d_available_at, a7 AS price_lag_7d_available_at FROM lagged""")
def local_lags(spark, d):
    """Price at the same clock 1, 2 and 7 days before, if known by the cutoff."""
    return rounded(_lagged(spark, d).drop("day", "period"))


def _vintages(spark, d) -> dict[str, DataFrame]:
    ev = read(spark, d, "events")
    of = lambda kind: ev.filter(F.col("event_type") == kind)
    later = lambda days: F.timestamp_add("DAY", days, F.col("ts"))
    demand = of("click").withColumn("_t", later((F.col("user_id") % 3 + 1).cast("int")))
    wind = of("view").withColumn("_t", later((F.col("user_id") % 2 + 1).cast("int")))
    emb = of("error").withColumn("_t", later(F.lit(1)))
    wx = of("signup").withColumn("_t", later(F.lit(1)))
    return {
        "demand": demand.select(half_hour("_t").alias("start_utc"), F.col("value").alias("demand"), F.col("ts").alias("demand_at"), "event_id"),
        "wind": wind.select(F.date_trunc("hour", "_t").cast("timestamp_ntz").alias("hour_utc"), F.col("value").alias("wind"), F.col("ts").alias("wind_at"), "event_id"),
        "emb": emb.select(half_hour("_t").alias("start_utc"), F.col("value").alias("emb"), (F.col("user_id") % 5).cast("double").alias("capacity"), F.col("ts").alias("emb_at"), "event_id"),
        "wx": wx.select(F.date_trunc("hour", "_t").cast("timestamp_ntz").alias("hour_utc"), (F.col("user_id") % 4).alias("location"), F.when(F.col("value") > 5, F.col("value")).alias("speed"), F.col("ts").alias("wx_at"), "event_id"),
    }


def _pick(kind: str, key: str, target: str, cols: str, at: str) -> str:
    return f"""(SELECT * FROM (SELECT sp.start_utc AS s0, {cols}, e.ts AS {at}, row_number() OVER (PARTITION BY sp.start_utc ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM sp JOIN events e ON e.event_type = '{kind}' AND {target} = sp.{key} AND e.ts <= sp.cutoff_utc) WHERE rn = 1)"""


def _target(days: str) -> str:
    x = f"(e.ts + to_days(CAST({days} AS INTEGER)))"
    return f"date_trunc('hour', {x}) + to_minutes(CAST(30 * (minute({x}) // 30) AS BIGINT))"


def _now(spark, d) -> str:
    """Noon of the fourth day before the last of `events`: the mart's latest days are not known yet."""
    return read(spark, d, "events").agg((F.date_sub(F.max("ts").cast("date"), 3).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOUR")).cast("string")).first()[0]


def full_mart(spark, d) -> DataFrame:
    """The whole mart: a spine whose cutoffs have passed, six feature groups, derived and relative features."""
    spine = mart.passed(_spine(spark, d), t.now_utc(_now(spark, d)))
    v = _vintages(spark, d)
    keys = ["day", "period"]
    at = lambda name, on, cols, issued: asof.asof_join(spine.select(*keys, "start_utc", "hour_utc", "cutoff_utc"), v[name], on, cols, issued, tie=["event_id"]).select(*keys, *cols, issued)
    hours = spine.select("hour_utc", "cutoff_utc").distinct()
    per = asof.asof_join(hours.crossJoin(v["wx"].select("location").distinct()), v["wx"], ["hour_utc", "location"], ["speed"], "wx_at", tie=["event_id"], how="inner")
    per = per.withColumns({"w": (F.col("location") + 1).cast("double"), "power": t.power_curve("speed")})
    weather = per.groupBy("hour_utc", "cutoff_utc").agg(series.weighted_mean("speed", "w").alias("wx_speed"), series.weighted_mean("power", "w").alias("wx_power"), F.max("wx_at").alias("wx_at"), F.count("*").alias("wx_locations"))
    lags = _lagged(spark, d).withColumn("price_at", t.newest("price_lag_1d_available_at", "price_lag_2d_available_at", "price_lag_7d_available_at"))
    cut = spine.select("day", "cutoff_utc").distinct()
    prices = half_hours(spark, d).withColumn("available_at", F.col("start_utc") + F.expr("INTERVAL 90 MINUTE")).select("price", "available_at")
    width = panes.pane_width(cut, "cutoff_utc", [7 * 86400, 86400])
    paned = panes.panes(prices, "available_at", width, {"price": F.col("price")}, last={"price_now": (F.col("price"), [])})
    week = panes.combined(cut, paned, "cutoff_utc", 7 * 86400, width, ["price"]).select("day", F.col("price_mean").alias("mean_7d"), F.col("price_sd").alias("sd_7d"))
    last = panes.combined(cut, paned, "cutoff_utc", 86400, width, [], last=["price_now"]).select("day", F.col("price_now_last").alias("price_last"))
    out = mart.back_to_grain(spine, weather, ["hour_utc", "cutoff_utc"], ["wx_locations"])
    out = mart.star(
        out,
        [
            (at("demand", ["start_utc"], ["demand"], "demand_at"), keys),
            (at("wind", ["hour_utc"], ["wind"], "wind_at"), keys),
            (at("emb", ["start_utc"], ["emb", "capacity"], "emb_at"), keys),
            (lags.select(*keys, "price_lag_1d", "price_lag_2d", "price_lag_7d", "price_at"), keys),
            (week, ["day"]),
            (last, ["day"]),
        ],
    )
    out = out.withColumns({"residual": F.col("demand") - F.col("wind"), "load_factor": mart.safe_ratio("emb", "capacity"), "share": mart.supply_share(["wind", "emb"], ["demand", "emb"])})
    out = mart.flagged(out, {"has_demand": "demand"})
    return mart.relative(out, ["price_lag_1d", "price_lag_2d", "price_lag_7d", "price_last"], "mean_7d")


_R = "price_lag_1d price_lag_2d price_lag_7d price_last".split()
_SHOWN = mart.feature_list(["day", "period", "demand", "wind", "residual", "emb", "load_factor", "wx_speed", "wx_power", "wx_locations", "share", "mean_7d", "sd_7d", *_R], add=[f"{c}_rel" for c in _R] + ["has_demand", "wx_at", "price_at", "target"], drop=["price_last"])


@query(f"""WITH {HALF_HOURS}, {_SPINE}, {_LAGGED}, w AS (SELECT sp.day, avg(price) AS mean_7d, stddev_samp(price) AS sd_7d, arg_max(price, hh.start_utc) FILTER (hh.start_utc + INTERVAL 90 MINUTE > cutoff_utc - INTERVAL 1 DAY) AS price_last
  FROM (SELECT DISTINCT day, cutoff_utc FROM sp) sp LEFT JOIN hh ON hh.start_utc + INTERVAL 90 MINUTE <= cutoff_utc AND hh.start_utc + INTERVAL 90 MINUTE > cutoff_utc - INTERVAL 7 DAY GROUP BY sp.day),
pl AS (SELECT * FROM (SELECT hr.hour_utc, hr.cutoff_utc, e.user_id % 4 AS location, CASE WHEN e.value > 5 THEN e.value END AS speed, e.ts, row_number() OVER (PARTITION BY hr.hour_utc, hr.cutoff_utc, e.user_id % 4 ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM (SELECT DISTINCT hour_utc, cutoff_utc FROM sp) hr JOIN events e ON e.event_type = 'signup' AND date_trunc('hour', e.ts + INTERVAL 1 DAY) = hr.hour_utc AND e.ts <= hr.cutoff_utc) WHERE rn = 1),
pw AS (SELECT *, location + 1.0 AS lw, CASE WHEN speed IS NULL THEN NULL WHEN speed < 3 OR speed >= 25 THEN 0 WHEN speed >= 12 THEN 1 ELSE power((speed - 3) / 9, 3) END AS power FROM pl),
wx AS (SELECT hour_utc, cutoff_utc, sum(speed * lw) / nullif(sum(CASE WHEN speed IS NOT NULL THEN lw END), 0) AS wx_speed, sum(power * lw) / nullif(sum(CASE WHEN power IS NOT NULL THEN lw END), 0) AS wx_power, max(ts) AS wx_at, count(*) AS wx_locations FROM pw GROUP BY ALL),
m AS (SELECT sp.*, de.demand, wi.wind, em.emb, em.capacity, wx_speed, wx_power, wx_at, coalesce(wx_locations, 0) AS wx_locations, price_lag_1d, price_lag_2d, price_lag_7d, greatest(a1, a2, a7) AS price_at, mean_7d, sd_7d, price_last
  FROM sp LEFT JOIN {_pick('click', 'start_utc', _target('e.user_id % 3 + 1'), 'e.value AS demand', 'demand_at')} de ON de.s0 = sp.start_utc
  LEFT JOIN {_pick('view', 'hour_utc', "date_trunc('hour', e.ts + to_days(CAST(e.user_id % 2 + 1 AS INTEGER)))", 'e.value AS wind', 'wind_at')} wi ON wi.s0 = sp.start_utc
  LEFT JOIN {_pick('error', 'start_utc', _target('1'), 'e.value AS emb, CAST(e.user_id % 5 AS DOUBLE) AS capacity', 'emb_at')} em ON em.s0 = sp.start_utc
  LEFT JOIN wx ON wx.hour_utc = sp.hour_utc AND wx.cutoff_utc = sp.cutoff_utc LEFT JOIN lagged USING (start_utc) LEFT JOIN w ON w.day = sp.day WHERE sp.cutoff_utc <= (SELECT CAST(CAST(max(ts) AS DATE) - 3 AS TIMESTAMP) + INTERVAL 12 HOUR FROM events))
SELECT m.day, m.period, round(demand, 6) AS demand, round(wind, 6) AS wind, round(demand - wind, 6) AS residual, round(emb, 6) AS emb, round(emb / nullif(capacity, 0), 6) AS load_factor, round(wx_speed, 6) AS wx_speed, round(wx_power, 6) AS wx_power, wx_locations,
 round((wind + emb) / nullif(demand + emb, 0), 6) AS share, round(mean_7d, 6) AS mean_7d, round(sd_7d, 6) AS sd_7d, round(price_lag_1d, 6) AS price_lag_1d, round(price_lag_2d, 6) AS price_lag_2d, round(price_lag_7d, 6) AS price_lag_7d,
 round(price_lag_1d - mean_7d, 6) AS price_lag_1d_rel, round(price_lag_2d - mean_7d, 6) AS price_lag_2d_rel, round(price_lag_7d - mean_7d, 6) AS price_lag_7d_rel, round(price_last - mean_7d, 6) AS price_last_rel,
 CASE WHEN demand IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_demand, wx_at, price_at, round(h.price, 6) AS target
FROM m LEFT JOIN h ON h.start_utc = m.start_utc WHERE m.day >= (SELECT CAST(min(ts) AS DATE) + 2 FROM events)""", "day")
def assembled_mart(spark, d):
    """The mart with its target."""
    target = half_hours(spark, d).select("day", "period", F.col("price").alias("target"))
    start = read(spark, d, "events").agg(F.date_add(F.min("ts").cast("date"), 2).cast("string")).first()[0]
    out = lake.mart(full_mart(spark, d), target, ["day", "period"], ["start_utc"], "day", start=start)
    return rounded(out.select(*_SHOWN))


@query("""SELECT event_id, user_id AS customer, ts AS at, CASE WHEN user_id > 10 THEN round(value, 6) END AS price FROM events
WHERE event_type = 'purchase' AND user_id > 10 AND value IS NOT NULL AND strftime(ts, '%H:%M:%S') >= '04:00:00' AND strftime(ts, '%H:%M:%S') < '11:00:00'""")
def staged_purchases(spark, d):
    """Renamed and typed rows of one kind, price null for small customers, known ones issued from 04:00 to before 11:00 local."""
    rows = mart.renamed(read(spark, d, "events"), {"event_id": ("event_id", "long"), "customer": ("user_id", "long"), "at": ("ts", "timestamp_ntz"), "price": ("value", "double")}, {"event_type": "purchase"})
    rows = rows.withColumn("price", mart.known_if("price", F.col("customer") > 10))
    return rounded(mart.issued_between(mart.known(rows, "price"), "at", "04:00:00", "11:00:00", ZONE))


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT * FROM o WHERE day < (SELECT date_trunc('month', max(day)) - INTERVAL 5 MONTH FROM o))
SELECT month(day) % 3 = 0 AS held_out, count(*) AS n, max(day) AS last_day, round(sum(o_totalprice), 2) AS total FROM b GROUP BY ALL""", "last_day")
def selection_cut(spark, d):
    """Orders before the last six months, whole months held out."""
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    rows = mart.before_holdout(o, "day", 6).withColumn("held_out", mart.whole_months("day"))
    return rows.groupBy("held_out").agg(F.count("*").alias("n"), F.max("day").alias("last_day"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, lines, round(quantity, 4) AS quantity FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def joined_aggregate(spark, d):
    """C20."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", r("o_totalprice", 2).alias("price"))
    li = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return rounded(mart.with_aggregate(o, li, ["o_orderkey"], [F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")]), 4)


@query(f"""WITH {_SPINE} SELECT sp.day, sp.period, round(sum(value * (user_id % 4 + 1)) / sum(user_id % 4 + 1), 6) AS seen, count(*) AS n FROM sp JOIN events e ON date_trunc('hour', e.ts) = sp.hour_utc GROUP BY ALL""", "day")
def observed_series(spark, d):
    """What was observed in the hour of each half-hour, whatever the cutoff."""
    ev = read(spark, d, "events").withColumns({"hour_utc": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "w": (F.col("user_id") % 4 + 1).cast("double")})
    return rounded(mart.observed(_spine(spark, d), ev, ["hour_utc"], [series.weighted_mean("value", "w").alias("seen"), F.count("*").alias("n")], ["day", "period"]))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def swapped_columns(spark, d):
    """Two columns from another table, the old value where it has none."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    other = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("price") * 2).alias("price"), F.lit("X").alias("o_orderstatus"))
    return rounded(mart.swapped(o, other, ["o_orderkey"], ["price", "o_orderstatus"]), 2)


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS price, lines FROM orders JOIN (SELECT o.o_orderkey, count(l_orderkey) AS lines FROM orders o LEFT JOIN lineitem ON l_orderkey = o.o_orderkey GROUP BY 1) USING (o_orderkey)""")
def one_to_one_join(spark, d):
    """Two tables with the same keys, each once."""
    o = read(spark, d, "orders").select("o_orderkey", r("o_totalprice", 2).alias("price"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one"))
    lines = o.select("o_orderkey").join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("one").alias("lines"))
    return mart.one_to_one(o, lines, ["o_orderkey"])


@query(f"""WITH {HALF_HOURS}, x AS (SELECT day, period, price, avg(price) OVER w AS m, count(price) OVER w AS c FROM h WINDOW w AS (PARTITION BY period ORDER BY day - DATE '1970-01-01' RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING))
SELECT day, period, round(CASE WHEN c >= 3 THEN m END, 6) AS slot_mean, round(price - CASE WHEN c >= 3 THEN m END, 6) AS price_rel, round(CASE WHEN c >= 3 THEN price END, 6) AS price_back FROM x""", "day")
def slot_profile(spark, d):
    """Mean of the same half-hour over days D-8 to D-2, looked up by day and period, the price less it, and that with the level added back."""
    from tidemark.operators.forecasts import delevelled, relevelled

    h = half_hours(spark, d)
    table = series.lagged_mean(h.withColumn("k", F.unix_date("day")), "price", ["period"], "k", 7).select("day", "period", "price_mean_7d")
    out = mart.looked_up(h.select("day", "period", "price"), table, ["day", "period"], "price_mean_7d", "slot_mean")
    out = delevelled(out, "price", "slot_mean", "price_rel").withColumn("price_back", F.col("price_rel"))
    return rounded(relevelled(out, ["price_back"], "slot_mean").drop("price"))


@query(f"""WITH {HALF_HOURS}, dd AS (SELECT day, day - DATE '1970-01-01' AS k, count(*) AS n, sum(n) AS sx, sum(price) AS sy, sum(n * n) AS sxx, sum(n * price) AS sxy FROM h GROUP BY day),
w AS (SELECT day, k - 2 - min(k) OVER () + 1 AS span, sum(n) OVER g AS n, sum(sx) OVER g AS sx, sum(sy) OVER g AS sy, sum(sxx) OVER g AS sxx, sum(sxy) OVER g AS sxy FROM dd WINDOW g AS (ORDER BY k RANGE BETWEEN 15 PRECEDING AND 2 PRECEDING)),
s AS (SELECT day, n, sx, sy, CASE WHEN span >= 7 AND n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope, span FROM w)
SELECT h.day, h.period, round(slope, 4) AS slope, round((sy - slope * sx) / s.n, 3) AS intercept, round((sy - slope * sx) / s.n + slope * h.n, 3) AS implied FROM h JOIN s USING (day)""", "day")
def merit_order(spark, d):
    """Price on the number of events over all half-hours of days D-15 to D-2, and the price implied for each half-hour."""
    h = half_hours(spark, d).withColumns({"k": F.unix_date("day"), "x": F.col("n").cast("double")})
    out = series.lagged_regression(h, "price", "x", [], "k")
    return out.select("day", "period", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("implied", 3).alias("implied"))


@query(f"""WITH {HALF_HOURS} SELECT start_utc, round(price - avg(price) OVER (PARTITION BY day), 6) AS deviation, round(power(0.5, (max(day) OVER () - day) / 10.0), 9) AS weight FROM h""")
def deviations_and_weights(spark, d):
    """Price less the day's mean, and a weight that halves every ten days back."""
    h = series.with_recency(half_hours(spark, d), "day", 10.0).withColumn("deviation", series.deviation("price", ["day"]))
    return h.select("start_utc", r("deviation").alias("deviation"), r("weight", 9).alias("weight"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, count(*) AS n FROM orders GROUP BY 1""", "month")
def monthly_levels(spark, d):
    """D23, H9."""
    return rounded(series.levels_by_month(read(spark, d, "orders"), "o_totalprice", "o_orderdate"), 4)


_PROFILE = f"{HALF_HOURS}, p AS (SELECT isodow(day) >= 6 AS flag, CAST(hour(start_utc) AS BIGINT) AS hour, avg(price) AS mean, count(price) AS n FROM h GROUP BY ALL)"


def _profile(spark, d) -> DataFrame:
    return series.profile(half_hours(spark, d), "price", t.iso_weekday("day") >= 6, F.hour("start_utc").cast("long"))


@query(f"WITH {_PROFILE} SELECT flag, hour, round(mean, 6) AS mean, n FROM p")
def weekend_profile(spark, d):
    """Mean by weekend and hour."""
    return rounded(_profile(spark, d))


@query(f"""WITH {_PROFILE} SELECT round(avg(mean) FILTER (NOT flag AND hour BETWEEN 16 AND 19) - avg(mean) FILTER (NOT flag), 6) AS peak_premium, round(avg(mean) FILTER (flag) - avg(mean) FILTER (NOT flag), 6) AS flag_discount FROM p""")
def profile_premiums(spark, d):
    """Premium of the evening peak and discount of weekends."""
    return rounded(series.profile_premiums(_profile(spark, d), (16, 19)))


@query(f"""WITH {HALF_HOURS}, k AS (SELECT *, price - avg(price) OVER (PARTITION BY day) AS v, count(price) OVER (PARTITION BY day) AS c FROM h),
c AS (SELECT l.lag, a.day, corr(a.v, b.v) AS c FROM (SELECT unnest([2, 7]) AS lag) l, k a JOIN k b ON b.period = a.period AND b.day = a.day - CAST(l.lag AS INTEGER) AND a.c > 40 AND b.c > 40 GROUP BY ALL)
SELECT CAST(lag AS BIGINT) AS lag, round(quantile_cont(c, 0.5), 6) AS median_corr, count(c) AS days FROM c GROUP BY lag""")
def shape_correlation(spark, d):
    """How well the shape of a day agrees with that two and seven days before."""
    h = half_hours(spark, d)
    out = series.shape_correlation(h, "price", "day", "period", 2).unionByName(series.shape_correlation(h, "price", "day", "period", 7))
    return rounded(out.filter("days > 0"))


@query(f"""WITH {HALF_HOURS}, {_SPINE}, {_LAGGED}, l AS (SELECT h.price AS y, price_lag_1d, price_lag_2d, price_lag_7d FROM lagged LEFT JOIN h USING (start_utc)),
u AS (SELECT y, unnest(['price_lag_1d', 'price_lag_2d', 'price_lag_7d']) AS feature, unnest([price_lag_1d, price_lag_2d, price_lag_7d]) AS x FROM l),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM u WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT feature, round(known_share, 6) AS known_share, round(mae, 6) AS mae, round(rank_corr, 6) AS rank_corr FROM (SELECT feature, avg(CAST(x IS NOT NULL AS INTEGER)) AS known_share, avg(abs(y - x)) AS mae FROM u GROUP BY 1) LEFT JOIN (SELECT feature, corr(a, b) AS rank_corr FROM r GROUP BY 1) USING (feature)""")
def lag_persistence(spark, d):
    """D26, D25, E9."""
    x = _lagged(spark, d).join(half_hours(spark, d).select("start_utc", F.col("price").alias("y")), "start_utc", "left")
    return rounded(series.lag_persistence(x, "y", ["price_lag_1d", "price_lag_2d", "price_lag_7d"]))


@query(f"""WITH {HALF_HOURS}, {_SPINE}, {_LAGGED}, s AS (SELECT unnest(['price_lag_1d', 'price_lag_2d', 'price_lag_7d']) AS column_name, unnest([avg(CAST(price_lag_1d IS NULL AS INTEGER)), avg(CAST(price_lag_2d IS NULL AS INTEGER)), avg(CAST(price_lag_7d IS NULL AS INTEGER))]) AS s FROM lagged)
SELECT column_name, round(s, 6) AS null_share FROM s WHERE s > 0.1""")
def null_shares(spark, d):
    """D30."""
    return rounded(series.missingness(_lagged(spark, d), ["price_lag_1d", "price_lag_2d", "price_lag_7d"], 0.1))


@query("""WITH o AS (SELECT *, o_orderdate >= TIMESTAMP '1998-01-01' AS later FROM orders)
SELECT 'o_totalprice' AS feature, round(avg(o_totalprice) FILTER (NOT later), 4) AS earlier, round(avg(o_totalprice) FILTER (later), 4) AS later FROM o
UNION ALL SELECT 'o_custkey', round(avg(o_custkey) FILTER (NOT later), 4), round(avg(o_custkey) FILTER (later), 4) FROM o""")
def drift(spark, d):
    """D31."""
    o = read(spark, d, "orders").withColumn("flag", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rounded(series.drift(o, "flag", ["o_totalprice", "o_custkey"]), 4)


@query("""WITH r AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_totalprice AS y, o_custkey AS x, CAST(o_orderstatus = 'F' AS INTEGER) AS f FROM orders),
k AS (SELECT quarter, rank() OVER (PARTITION BY quarter ORDER BY x) + (count(*) OVER (PARTITION BY quarter, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY quarter ORDER BY y) + (count(*) OVER (PARTITION BY quarter, y) - 1) / 2.0 AS b FROM r)
SELECT quarter, round(slope, 5) AS slope, round(fitted, 2) AS fitted, round(rank_corr, 6) AS rank_corr, round(f, 6) AS f_mean, n FROM
 (SELECT quarter, regr_slope(y, x) AS slope, regr_intercept(y, x) + 20 * regr_slope(y, x) AS fitted, avg(f) AS f, count(*) AS n FROM r GROUP BY 1) JOIN (SELECT quarter, corr(a, b) AS rank_corr FROM k GROUP BY 1) USING (quarter)""")
def merit_by_quarter(spark, d):
    """Slope, fitted value at 20, rank correlation and mean share by quarter."""
    o = read(spark, d, "orders").select(t.quarter_label("o_orderdate").alias("quarter"), F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_orderstatus") == "F").cast("double").alias("f"))
    out = series.regression_by(o, "y", "x", ["quarter"], 20.0, share="f")
    return out.select("quarter", r("slope", 5).alias("slope"), r("fitted", 2).alias("fitted"), r("rank_corr").alias("rank_corr"), r("f_mean").alias("f_mean"), "n")


@query("""WITH x AS (SELECT value - 20 AS v, CASE WHEN user_id < 20 THEN 0 WHEN user_id < 60 THEN 1 WHEN user_id < 1000 THEN 2 END AS bin FROM events)
SELECT CAST(bin AS BIGINT) AS bin, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 6) AS spread, round(avg(CAST(v < 0 AS INTEGER)), 6) AS share_negative FROM x WHERE bin IS NOT NULL GROUP BY ALL""")
def bins_with_tail(spark, d):
    """D27."""
    ev = read(spark, d, "events").withColumn("v", F.col("value") - 20)
    return rounded(series.binned(ev, "v", "user_id", [0, 20, 60, 1000]))


@query("""SELECT event_type, count(value) AS n, round(avg(value) - quantile_cont(value, 0.5), 6) AS mean_less_median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(CAST(value < 0 AS INTEGER)), 6) AS share_negative FROM events GROUP BY ALL""")
def tails(spark, d):
    """D21."""
    x = series.moments(read(spark, d, "events"), "value", ["event_type"], (0.25, 0.75), 100.0)
    return rounded(x.select("event_type", "n", "mean_less_median", "q25", "q75", "share_negative"))


@query("""SELECT user_id, arg_min(event_type, event_id) AS first_event_type, arg_min(event_id, event_id) AS first_event_id, arg_max(event_type, event_id) AS last_event_type, arg_max(event_id, event_id) AS last_event_id FROM events GROUP BY 1""")
def first_and_last_event(spark, d):
    """E12."""
    return series.first_and_last(read(spark, d, "events"), ["user_id"], ["event_id"], ["event_type", "event_id"])


@query("""WITH r AS (SELECT event_type, user_id, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS t, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS l FROM events WHERE value IS NOT NULL)
SELECT a.event_type, a.event_id AS top_event_id, round(a.value, 6) AS top_value, b.event_id AS low_event_id, round(b.value, 6) AS low_value FROM r a JOIN r b ON a.event_type = b.event_type AND a.t = 1 AND b.l = 1""")
def best_and_worst(spark, d):
    """F4."""
    return rounded(series.best_of(read(spark, d, "events"), ["event_type"], "value", ["event_id", "value"], ["event_id"]))


@query("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(value) AS n, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1 HAVING count(value) >= 100 ORDER BY stddev_samp(value) DESC, 1 LIMIT 1""", "week")
def volatile_week(spark, d):
    """F5."""
    return rounded(serve.most_volatile_week(read(spark, d, "events"), "ts", "value", 100))


@query("""SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""", "day")
def latest_day_events(spark, d):
    """F7."""
    return serve.latest_day(read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day")), "day")


@query("""SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)) AS left_only,
 (SELECT count(*) FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS right_only, 'l_tax,o_custkey' AS columns_differ""")
def key_sets(spark, d):
    """Keys of two tables, and columns that only one has."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_tax")
    o = read(spark, d, "orders").filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return series.key_diff(li, o, ["k"])


@query("""WITH x AS (SELECT 'orders' AS table_name, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT 'lineitem', CAST(l_shipdate AS DATE) FROM lineitem), c AS (SELECT min(m) AS c FROM (SELECT max(d) AS m FROM x GROUP BY table_name))
SELECT table_name, count(CASE WHEN d > c THEN 1 END) AS beyond, max(c) AS common_end FROM x, c GROUP BY 1""", "common_end")
def beyond_common_range(spark, d):
    """G6."""
    a = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    b = read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return series.beyond_common_range({"orders": a, "lineitem": b}, "day")


@query("""WITH v AS (SELECT user_id, CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS day, max(value) AS value, max(ts) AS ts FROM events WHERE event_type = 'purchase' AND event_id % 3 = 1 GROUP BY 1, 2),
s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view')
SELECT count(v.ts) AS n, round(avg(CAST(v.ts > CAST(s.day AS TIMESTAMP) - INTERVAL 15 HOUR AS INTEGER)), 6) AS share_late FROM s JOIN v USING (user_id, day)""")
def fixed_lead_share(spark, d):
    """Forecasts of a fixed lead whatever the cutoff, and the share issued late."""
    ev = read(spark, d, "events")
    lead = (F.col("event_id") % 3).cast("int")
    v = ev.filter("event_type = 'purchase'").withColumns({"lead_days": lead, "day": F.date_add(F.col("ts").cast("date"), lead)})
    v = v.groupBy("user_id", "day", "lead_days").agg(F.max("value").alias("value"), F.max("ts").alias("issued"))
    spine = ev.filter("event_type = 'view'").select("user_id", F.col("ts").cast("date").alias("day")).distinct().withColumn("cutoff_utc", t.cutoff_utc("day", ZONE))
    return rounded(asof.late_share(asof.fixed_lead_join(spine, v, ["user_id", "day"], ["value"], 1, "issued")))


@query(f"""WITH {_SPINE}, c AS (SELECT DISTINCT day, cutoff_utc FROM sp),
a AS (SELECT day, avg(value) AS view_mean_24h FROM c JOIN events ON event_type = 'view' AND ts <= cutoff_utc AND ts > cutoff_utc - INTERVAL 24 HOUR GROUP BY 1),
b AS (SELECT day, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / nullif(sum(value), 0) AS click_share_7d, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / nullif(sum(value), 0) AS error_share_7d, max(ts) AS system_at FROM c JOIN events ON ts <= cutoff_utc AND ts > cutoff_utc - INTERVAL 7 DAY GROUP BY 1),
d AS (SELECT day, avg(value) AS bought_mean_7d FROM c JOIN events ON event_type = 'purchase' AND ts <= cutoff_utc AND ts > cutoff_utc - INTERVAL 7 DAY GROUP BY 1)
SELECT c.day, round(view_mean_24h, 6) AS view_mean_24h, round(click_share_7d, 6) AS click_share_7d, round(error_share_7d, 6) AS error_share_7d, system_at, round(bought_mean_7d, 6) AS bought_mean_7d FROM c LEFT JOIN a USING (day) LEFT JOIN b USING (day) LEFT JOIN d USING (day)""", "day")
def system_state(spark, d):
    """Three series up to each day's cutoff, over 24 hours and seven days."""
    ev = read(spark, d, "events").select("event_type", "value", "ts")
    days = _spine(spark, d).select("day", "cutoff_utc").distinct()
    width = panes.pane_width(days, "cutoff_utc", [86400, 7 * 86400])
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    paned = panes.panes(ev, "ts", width, {"view": of("view"), "click": of("click"), "error": of("error"), "bought": of("purchase"), "every": F.col("value")})
    day = panes.combined(days, paned, "cutoff_utc", 86400, width, ["view"]).select("day", F.col("view_mean").alias("view_mean_24h"))
    week = panes.combined(days, paned, "cutoff_utc", 7 * 86400, width, ["click", "error", "bought", "every"])
    share = lambda kind: F.when(F.col("newest").isNotNull(), F.coalesce(f"{kind}_total", F.lit(0.0))) / F.nullif(F.col("every_total"), F.lit(0.0))
    week = week.select("day", share("click").alias("click_share_7d"), share("error").alias("error_share_7d"), F.col("newest").alias("system_at"), F.col("bought_mean").alias("bought_mean_7d"))
    out = mart.star(days, [(day, ["day"]), (week, ["day"])])
    return rounded(out.drop("cutoff_utc"))


@query(f"""WITH {HALF_HOURS}, x AS (SELECT day, start_utc, CASE WHEN day < (SELECT max(day) FROM h) - 2 OR period % 5 > 0 THEN price END AS target FROM h), s AS (SELECT max(day) AS last FROM (SELECT day FROM x GROUP BY 1 HAVING avg(CAST(target IS NOT NULL AS INTEGER)) >= 0.9))
SELECT start_utc, round(target, 6) AS target FROM x, s WHERE day <= last""")
def complete_until(spark, d):
    """Rows up to the last day whose targets are known for nine tenths."""
    h = half_hours(spark, d)
    last = h.agg(F.max("day").alias("_m"))
    x = h.join(F.broadcast(last)).withColumn("target", F.when((F.col("day") < F.date_sub("_m", 2)) | (F.col("period") % 5 > 0), F.col("price")))
    return rounded(series.complete_until(x, "day", "target").select("start_utc", "target"))


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn % 3 = 1""")
def every_third_order(spark, d):
    """A sampling operator: every third order of each customer in order of time."""
    return lake.systematic_sample(read(spark, d, "orders"), 3, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""WITH c AS (SELECT strftime(ts, '%Y%m%d') AS chunk, count(*) AS n, CASE WHEN count(*) > 340 THEN 'fetched' WHEN count(*) > 320 THEN 'from_cache' ELSE 'skipped' END AS outcome FROM events GROUP BY 1)
SELECT outcome, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS "rows" FROM c GROUP BY 1""")
def ingest_outcomes(spark, d):
    """Chunks and rows by outcome."""
    c = read(spark, d, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("chunk")).agg(F.count("*").alias("rows"))
    c = c.withColumn("outcome", F.when(F.col("rows") > 340, "fetched").when(F.col("rows") > 320, "from_cache").otherwise("skipped"))
    return lake.outcome_counts(c)


@query("""SELECT strftime(ts, '%Y%m%d') || '-' || strftime(ts, '%Y%m%d') AS _chunk, count(*) AS "rows" FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 10 GROUP BY 1""")
def recent_chunks(spark, d):
    """Chunks that end within the last ten days, and their rows."""
    ev = lake.stamped(read(spark, d, "events"), t.chunk_key(F.col("ts").cast("date"), 1), "2024-01-31 00:00:00")
    return lake.recent_chunks(ev, "2024-01-31", 10)
