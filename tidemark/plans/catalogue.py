"""Registered queries over the driver's tables and the same in DuckDB SQL.

`events` stands for price series and vintages, `orders` for daily series,
`lineitem` for forecasts with actuals (quantiles of its part as prediction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.functions import timeutil as t
from tidemark.operators import contracts, folds, forecasts, mart, panes, series, settle
from tidemark.operators.asof import asof_join, keep_latest, newer_vintage_existed
from tidemark.operators.band import trailing
from tidemark.operators.calendar import settlement_calendar
from tidemark.plans import serve
from tidemark.plans.registry import ORACLE_SQL, QUERIES, ZONE, query, r, read, rounded  # noqa: F401
from tidemark.sources import lake, normalise
from tidemark.sources.staging import staged

_query, _read, _r, _rounded = query, read, r, rounded


def _days(ev: DataFrame) -> DataFrame:
    """The days of `events` but the first, each with its cutoff."""
    days = ev.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b")).filter("b > a")
    days = days.select(F.explode(F.sequence(F.date_add("a", 1), F.col("b"))).alias("day"))
    return days.withColumn("cutoff_utc", t.cutoff_utc("day", ZONE))


_DAYS = """days AS (SELECT CAST(d AS DATE) AS day, timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP) - INTERVAL 15 HOUR)) AS cutoff_utc
  FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE) + INTERVAL 1 DAY, CAST(CAST(max(ts) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM events))"""


def feature_mart(spark: SparkSession, d: str) -> DataFrame:
    """Newest purchase of each user by the cutoff beside trailing stats of views."""
    ev = _read(spark, d, "events")
    days = _days(ev)
    spine = ev.select("user_id").distinct().crossJoin(F.broadcast(days))
    bought = ev.filter("event_type = 'purchase'").select("user_id", F.col("value").alias("last_purchase"), F.col("ts").alias("purchase_at"), "event_id")
    spine = asof_join(spine, bought, ["user_id"], ["last_purchase"], "purchase_at", tie=["event_id"])
    views = ev.filter("event_type = 'view'").select("value", "ts", "event_id")
    width = panes.pane_width(days, "cutoff_utc", [7 * 86400, 86400])
    paned = panes.panes(views, "ts", width, {"views": F.col("value")}, last={"view": (F.col("value"), ["event_id"])})
    week = panes.combined(days, paned, "cutoff_utc", 7 * 86400, width, ["views"])
    week = week.select("cutoff_utc", *[F.when(F.col("newest").isNotNull(), F.col(f"views_{x}")).alias(y) for x, y in (("n", "n_views_7d"), ("mean", "mean_7d"), ("sd", "sd_7d"), ("low", "low_7d"), ("high", "high_7d"))], F.col("newest").alias("views_at"))
    last = panes.combined(days, paned, "cutoff_utc", 86400, width, [], last=["view"]).select("cutoff_utc", F.col("view_last").alias("last_view"))
    return spine.join(week, "cutoff_utc", "left").join(last, "cutoff_utc", "left")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feature_mart(spark, d))


_MART = f"""WITH {_DAYS}, users AS (SELECT DISTINCT user_id FROM events), spine AS (SELECT user_id, day, cutoff_utc FROM users, days),
v AS (SELECT * FROM events WHERE event_type = 'view'),
p AS (SELECT s.user_id, s.day, e.value AS last_purchase, e.ts AS purchase_at,
  row_number() OVER (PARTITION BY s.user_id, s.day ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM spine s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts <= s.cutoff_utc),
w AS (SELECT day, count(value) AS n_views_7d, avg(value) AS mean_7d, stddev_samp(value) AS sd_7d, min(value) AS low_7d, max(value) AS high_7d, max(ts) AS views_at
  FROM days JOIN v ON v.ts <= cutoff_utc AND v.ts > cutoff_utc - INTERVAL 7 DAY GROUP BY day),
k AS (SELECT day, arg_max(value, (ts, event_id)) AS last_view FROM days JOIN v ON v.ts <= cutoff_utc AND v.ts > cutoff_utc - INTERVAL 1 DAY AND value IS NOT NULL GROUP BY day)"""


@_query(f"""{_MART} SELECT s.cutoff_utc, s.user_id, s.day, round(last_purchase, 6) AS last_purchase, purchase_at, n_views_7d,
  round(mean_7d, 6) AS mean_7d, round(sd_7d, 6) AS sd_7d, round(low_7d, 6) AS low_7d, round(high_7d, 6) AS high_7d, views_at, round(last_view, 6) AS last_view
  FROM spine s LEFT JOIN (SELECT * FROM p WHERE rn = 1) p ON p.user_id = s.user_id AND p.day = s.day LEFT JOIN w ON w.day = s.day LEFT JOIN k ON k.day = s.day""", "day")
def mart_features(spark, d):
    return flagship(spark, d)


@_query(f"""{_MART}, b AS (SELECT day, event_type, count(DISTINCT user_id) AS users, bit_xor(event_id) AS mark, max(ts) AS newest FROM days JOIN events e ON e.ts <= cutoff_utc AND e.ts > cutoff_utc - INTERVAL 3 DAY GROUP BY ALL)
SELECT day, event_type, users, mark, newest FROM b""", "day")
def band_users(spark, d):
    """What panes can't add up, over a band by key: distinct users of the three days before each cutoff, and a mark of the rows in it."""
    ev, days = _read(spark, d, "events"), _days(_read(spark, d, "events"))
    kinds = days.crossJoin(ev.select("event_type").distinct())
    found = trailing(kinds, ev, "cutoff_utc", "ts", 3 * 86400, [F.countDistinct("user_id").alias("users"), F.bit_xor("event_id").alias("mark"), F.max("ts").alias("newest")], by=["event_type"])
    return found.filter("newest is not null").select("day", "event_type", "users", "mark", "newest")


@_query(f"""{_MART}, picks AS (SELECT s.*, purchase_at FROM spine s LEFT JOIN (SELECT * FROM p WHERE rn = 1) p USING (user_id, day)), e AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT (SELECT count(*) FROM picks WHERE purchase_at > cutoff_utc) AS leaks, (SELECT count(*) FROM picks q WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = q.user_id AND e.ts <= q.cutoff_utc AND (q.purchase_at IS NULL OR e.ts > q.purchase_at))) AS newer,
 (SELECT count(*) > 0 FROM picks JOIN e USING (user_id) WHERE e.ts > cutoff_utc AND e.ts <= cutoff_utc + INTERVAL 180 MINUTE) AS canary_fails""")
def mart_contracts(spark, d):
    """No leaks in the mart, none passed over, and a leaky join is caught."""
    ev = _read(spark, d, "events").filter("event_type = 'purchase'").select("user_id", F.col("value").alias("x"), F.col("ts").alias("at"), "event_id")
    days = _days(_read(spark, d, "events"))
    # the honest cutoff and one three hours late, in one join
    late = F.explode(F.array(F.lit(0), F.lit(180))).alias("late")
    spine = ev.select("user_id").distinct().crossJoin(F.broadcast(days.select("day", "cutoff_utc", late)))
    spine = spine.withColumn("bound", F.timestamp_add("MINUTE", F.col("late"), F.col("cutoff_utc")))
    picks = staged(asof_join(spine, ev, ["user_id"], ["x"], "at", "bound", tie=["event_id"]), "picks")
    a = contracts.point_in_time(picks, {"at": ["x"]}).agg(F.count_if(F.col("late") == 0).alias("leaks"), (F.count_if(F.col("late") > 0) > 0).alias("canary_fails"))
    b = newer_vintage_existed(picks.filter("late = 0"), ev.select("user_id", "at"), ["user_id"], "at").agg(F.count("*").alias("newer"))
    return a.join(F.broadcast(b)).select("leaks", "newer", "canary_fails")


@_query("""WITH d AS (SELECT CAST(g AS DATE) AS day, timezone('UTC', timezone('Europe/London', CAST(g AS TIMESTAMP))) AS a, timezone('UTC', timezone('Europe/London', CAST(g AS TIMESTAMP) + INTERVAL 1 DAY)) AS b
  FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + 420, INTERVAL 1 DAY)) AS g FROM events))
SELECT c.*, coalesce(k, 0) AS events FROM (SELECT day, count(*) AS n, min(start_utc) AS first_utc, max(start_utc) AS last_utc FROM (SELECT day, unnest(generate_series(a, b - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS start_utc FROM d) GROUP BY day) c
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS k FROM events GROUP BY 1) e USING (day)""", "day")
def calendar_days(spark, d):
    """Half-hours of the days from the first event on, over two springs."""
    r = _read(spark, d, "events").agg(F.min("ts").cast("date").cast("string").alias("a"), F.date_add(F.max("ts").cast("date"), 420).cast("string").alias("b")).first()
    per = _read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("events"))
    out = settlement_calendar(spark, r.a, r.b).groupBy("day").agg(F.count("*").alias("n"), F.min("start_utc").alias("first_utc"), F.max("start_utc").alias("last_utc"))
    return out.join(per, "day", "left").withColumn("events", F.coalesce("events", F.lit(0)))


@_query("""SELECT event_id, timezone('Europe/London', timezone('UTC', ts + INTERVAL 91 DAY)) AS local_ts, isodow(ts) AS weekday,
  hour(ts) * 2 + minute(ts) // 30 AS slot, year(ts) || 'Q' || quarter(ts) AS quarter, round(hour(ts) + minute(ts) / 60.0, 6) AS local_hour,
  CAST(ts AS DATE) + CAST(7 - isodow(ts) AS INTEGER) AS week_ending,
  round(CASE WHEN value IS NULL THEN NULL WHEN value < 3 OR value >= 25 THEN 0 WHEN value >= 12 THEN 1 ELSE power((value - 3) / 9, 3) END, 6) AS power FROM events""", "week_ending")
def scalar_functions(spark, d):
    """H1, H8, H12, H13, H15, H25."""
    ev = _read(spark, d, "events")
    out = ev.select("event_id", t.to_local(F.col("ts") + F.expr("INTERVAL 91 DAY"), ZONE).alias("local_ts"), t.iso_weekday("ts").alias("weekday"), t.half_hour_slot("ts").alias("slot"), t.quarter_label("ts").alias("quarter"), t.fractional_hour("ts").cast("double").alias("local_hour"), t.week_ending(F.col("ts").cast("date")).alias("week_ending"), t.power_curve("value").alias("power"))
    return _rounded(out)


@_query("""SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS deliveries FROM events WHERE (user_id, event_type, ts) IN
  (SELECT (user_id, event_type, max(ts)) FROM events GROUP BY user_id, event_type) GROUP BY ALL""")
def latest_delivery(spark, d):
    """Newest event per user and type, and how many share its time."""
    ev = _read(spark, d, "events")
    top = keep_latest(ev, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "ts", "event_id")
    same = ev.select("user_id", "event_type", "ts").groupBy("user_id", "event_type", "ts").agg(F.count("*").alias("deliveries"))
    return top.join(same, ["user_id", "event_type", "ts"]).drop("ts")


@_query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS k10, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def json_props(spark, d):
    """A field of JSON text, typed."""
    ev = normalise.json_fields(_read(spark, d, "events"), "props", {"k": ("k", "long")})
    out = ev.groupBy("event_type", F.floor(F.col("k") / 10).alias("k10")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return _rounded(out)


@_query("""SELECT n_name, r_name, count(*) AS suppliers, round(sum(s_acctbal * w) / nullif(sum(CASE WHEN s_acctbal IS NOT NULL THEN w END), 0), 6) AS mean
FROM (SELECT s.*, n_name, coalesce(r_name, 'other') AS r_name, s_suppkey % 7 + 1 AS w FROM supplier s JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey) GROUP BY ALL""")
def weighted_by_nation(spark, d):
    """Dimension with a default, and a null-aware weighted mean."""
    s = _read(spark, d, "supplier")
    w = s.select("s_suppkey", (F.col("s_suppkey") % 7 + 1).alias("w"))
    rows = mart.with_weights(s, w, ["s_suppkey"], "w").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = mart.with_dimension(rows, _read(spark, d, "region").filter("r_regionkey < 3"), {"n_regionkey": "r_regionkey"}, {"r_name": "other"})
    return _rounded(rows.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"), series.weighted_mean("s_acctbal", "w").alias("mean")))


@_query("""SELECT event_type, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS high, round(sum(CASE WHEN value <= 50 THEN value ELSE 0 END), 4) AS low,
  round(sum(value) / nullif(sum(user_id), 0), 9) AS ratio, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def pivot_sums(spark, d):
    """D2, D3, D33."""
    ev = _read(spark, d, "events")
    value, high = F.col("value"), F.col("value") > 50
    out = series.conditional_sums(ev, ["event_type"], {"high": (high, value), "low": (~high, value)}, [series.ratio_of_sums("value", "user_id").alias("ratio"), *series.distinct_of({"users": "user_id"})])
    return out.select("event_type", _r("high", 4).alias("high"), _r("low", 4).alias("low"), _r("ratio", 9).alias("ratio"), "users")


def _lines(spark, d) -> DataFrame:
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("g"), F.col("l_extendedprice").alias("y"), "l_shipdate", "l_returnflag")


def _quantiles(li: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each quantity and of all lines, staged."""
    return series.group_and_overall_quantiles(li, "y", ["g"], [0.1, 0.5, 0.9])


def _forecasts(spark, d, near: tuple[str, ...] = (), quantiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row per line and model; the lines stay where they are, or are dealt by `near` once, before they are a row per model. What _quantiles returned may be used again."""
    li = _lines(spark, d)
    by_quantity, constant = (q.select(*[c for c in q.columns if c == "g"], F.struct("p10", "p50", "p90").alias(f"_{n}")) for n, q in zip(("g", "one"), quantiles or _quantiles(li), strict=True))
    rows = series.beside(series.dealt(li, near) if near else li, by_quantity, ["g"]).crossJoin(F.broadcast(constant))
    both = F.array(*[F.struct(F.lit(n).alias("model"), f"{q}.p10", f"{q}.p50", f"{q}.p90") for n, q in (("by_quantity", "_g"), ("constant", "_one"))])
    return rows.select(*li.columns, F.inline(both)).filter("model = 'constant' or g is not null")


def _constant(spark, d) -> DataFrame:
    """The rows of _forecasts whose model is constant, without counting any groups."""
    li = _lines(spark, d)
    one = staged(series.group_quantiles(li, "y", [], [0.1, 0.5, 0.9]), "quantiles")
    return li.crossJoin(F.broadcast(one)).withColumn("model", F.lit("constant"))


_FORECASTS = """li AS (SELECT l_orderkey, l_linenumber, l_quantity AS g, l_extendedprice AS y, l_shipdate, l_returnflag FROM lineitem),
q AS (SELECT g, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM li GROUP BY g),
f AS (SELECT li.*, p10, p50, p90, 'by_quantity' AS model FROM li JOIN q USING (g)
  UNION ALL SELECT li.*, p10, p50, p90, 'constant' FROM li, (SELECT quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM li)),
l AS (SELECT *, (greatest(0.1 * (y - p10), -0.9 * (y - p10)) + greatest(0.5 * (y - p50), -0.5 * (y - p50)) + greatest(0.9 * (y - p90), -0.1 * (y - p90))) / 3 AS loss FROM f)"""


@_query(f"""WITH {_FORECASTS}, s AS (SELECT unnest(['all', l_returnflag]) AS scope, * FROM l),
a AS (SELECT scope, model, count(y) AS n, avg(loss) AS pinball, avg(abs(p50 - y)) AS mae, sqrt(avg((p50 - y) * (p50 - y))) AS rmse, avg(p50 - y) AS bias,
  avg(CAST(y BETWEEN p10 AND p90 AS INTEGER)) AS coverage, avg(p90 - p10) AS width FROM s GROUP BY ALL)
SELECT scope, model, n, round(pinball, 4) AS pinball, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(bias, 4) AS bias, round(coverage, 6) AS coverage, round(width, 4) AS width,
  round(1 - pinball / nullif(max(CASE WHEN model = 'constant' THEN pinball END) OVER (PARTITION BY scope), 0), 6) AS skill FROM a""")
def forecast_summary(spark, d):
    """D8 to D12, C26."""
    out = m.scope_summary(_forecasts(spark, d), F.col("l_returnflag"), "constant")
    r4 = lambda c: _r(c, 4).alias(c)
    return out.select("scope", "model", "n", r4("pinball"), r4("mae"), r4("rmse"), r4("bias"), _r("coverage").alias("coverage"), r4("width"), _r("skill").alias("skill"))


@_query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT date_trunc('month', min(day)) + INTERVAL 36 MONTH AS a, max(day) AS b FROM o),
f AS (SELECT strftime(g, '%Y-%m') AS fold, CAST(g AS DATE) AS test_start, least(last_day(g), b) AS test_end, CAST(g AS DATE) - 2 AS train_end FROM (SELECT b, unnest(generate_series(a, CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS g FROM s))
SELECT fold, train_end, count(CASE WHEN day <= train_end THEN 1 END) AS n_train, count(CASE WHEN day BETWEEN test_start AND test_end THEN 1 END) AS n_test,
  round(avg(CASE WHEN day <= train_end THEN o_totalprice END), 4) AS train_mean FROM f, o GROUP BY ALL""", "train_end")
def walk_forward(spark, d):
    """Months from the fourth year to the last day, trained on all before; orders are summed per day first."""
    o = _read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    sums = folds.day_prefixes(o, "day", {"n": F.lit(1), "s": F.col("o_totalprice"), "k": F.when(F.col("o_totalprice").isNotNull(), 1)})
    span = o.agg(F.add_months(F.trunc(F.min("day"), "month"), 36).cast("string").alias("a"), F.max("day").cast("string").alias("b")).first()
    out = folds.fold_sums(forecasts.monthly_folds(spark, span.a, span.b), sums, ["n", "s", "k"])
    return out.select("fold", "train_end", F.col("train_n").cast("long").alias("n_train"), _r(F.col("train_s") / F.nullif(F.col("train_k"), F.lit(0.0)), 4).alias("train_mean"), F.col("test_n").cast("long").alias("n_test"))


@_query(f"""WITH {_FORECASTS} SELECT l_returnflag, round(quantile_cont(y - p10, 0.1), 4) AS shift_p10, round(quantile_cont(y - p50, 0.5), 4) AS shift_p50, round(quantile_cont(y - p90, 0.9), 4) AS shift_p90, count(y) AS n_calibration
FROM f WHERE model = 'constant' GROUP BY ALL""")
def conformal(spark, d):
    """Shifts of each group (their hold-out is in calibrated_by_group)."""
    return _rounded(forecasts.conformal_shifts(_constant(spark, d), "y", [0.1, 0.5, 0.9], ["l_returnflag"]), 4)


_DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1)"


def _daily(spark, d) -> DataFrame:
    return _read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


@_query(f"""WITH {_DAILY}, x AS (SELECT *, year(day) AS y, day - DATE '1970-01-01' AS k FROM daily)
SELECT day, round(CASE WHEN count(total) OVER w >= 3 THEN avg(total) OVER w END, 4) AS mean7,
 round(CASE WHEN k - 2 - min(k) OVER (PARTITION BY y) + 1 >= 7 THEN (count(*) OVER g * sum(total * n) OVER g - sum(n) OVER g * sum(total) OVER g) / nullif(count(*) OVER g * sum(n * n) OVER g - (sum(n) OVER g) * (sum(n) OVER g), 0) END, 3) AS slope
FROM x WINDOW w AS (PARTITION BY y ORDER BY k RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING), g AS (PARTITION BY y ORDER BY k RANGE BETWEEN 15 PRECEDING AND 2 PRECEDING)""", "day")
def rolling_features(spark, d):
    """By year, so that no task holds the whole series."""
    x = _daily(spark, d).withColumns({"y": F.year("day"), "k": F.unix_date("day")})
    x = series.lagged_mean(x, "total", ["y"], "k", 7)
    x = series.lagged_regression(x.withColumn("xn", F.col("n").cast("double")), "total", "xn", ["y"], "k")
    return x.select("day", _r("total_mean_7d", 4).alias("mean7"), _r("slope", 3).alias("slope"))


@_query(f"""WITH {_DAILY} SELECT day, round(sum(total) OVER w, 2) AS total_cum, round(sum(total * n) OVER w / sum(n) OVER w, 3) AS total_to_date,
 round(CASE WHEN count(total) OVER r >= 5 THEN avg(total) OVER r END, 4) AS total_rolling FROM daily
 WINDOW w AS (PARTITION BY year(day) ORDER BY day), r AS (PARTITION BY year(day) ORDER BY day ROWS 9 PRECEDING)""", "day")
def running_totals(spark, d):
    """E5 to E7."""
    x = _daily(spark, d).withColumn("y", F.year("day"))
    x = series.running(series.running(x, "total", ["y"], ["day"]), "total", ["y"], ["day"], "n")
    x = series.rolling_mean(x, "total", ["y"], ["day"], 10)
    return x.select("day", _r("total_cum", 2).alias("total_cum"), _r("total_to_date", 3).alias("total_to_date"), _r("total_rolling", 4).alias("total_rolling"))


@_query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt,
 round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95,
 round(avg(CAST(l_extendedprice > 50000 AS INTEGER)), 6) AS share_tail FROM lineitem GROUP BY ALL""")
def distribution(spark, d):
    """D21, D20."""
    x = series.moments(_read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], (0.05, 0.5, 0.95), 50000)
    return x.select("l_returnflag", "n", *[_r(c, 4).alias(c) for c in ("mean", "q05", "q50", "q95")], *[_r(c).alias(c) for c in ("skew", "kurt", "share_tail")])


@_query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)
SELECT event_type, round(corr(a, b), 6) AS rank_corr, count(*) AS n FROM r GROUP BY ALL""")
def rank_correlation(spark, d):
    """D25, E9."""
    return _rounded(series.spearman(_read(spark, d, "events"), "value", "user_id", ["event_type"]))


@_query("""SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept, count(*) AS n FROM orders GROUP BY ALL""")
def slope_by_quarter(spark, d):
    """D22."""
    o = _read(spark, d, "orders").withColumn("quarter", t.quarter_label("o_orderdate"))
    x = series.regression_by(o, "o_totalprice", "o_custkey", ["quarter"], 20.0)
    return x.select("quarter", _r("slope").alias("slope"), _r("intercept", 3).alias("intercept"), "n")


@_query(f"""WITH {_DAILY} SELECT CAST(k AS BIGINT) AS lag, round(corr(a.total, b.total), 6) AS corr FROM daily a JOIN (SELECT unnest([1, 7, 28]) AS k) ON true JOIN daily b ON b.day = a.day - CAST(k AS INTEGER) GROUP BY k""")
def day_autocorrelation(spark, d):
    """D28."""
    return _rounded(series.autocorrelation(_daily(spark, d), "total", "day", [1, 7, 28]))


@_query("""WITH x AS (SELECT *, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 WHEN value < 1000 THEN 3 END AS bin FROM events WHERE value >= 0)
SELECT CAST(bin AS BIGINT) AS bin, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread FROM x WHERE bin IS NOT NULL GROUP BY ALL""")
def value_bins(spark, d):
    """D27."""
    return _rounded(series.binned(_read(spark, d, "events"), "value", "value", [0, 10, 50, 100, 1000]).drop("share_negative"))


@_query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
x AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p1 FROM e
 WINDOW a AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS filled FROM x""")
def interpolation(spark, d):
    """E11."""
    from pyspark.sql import Window

    e = _read(spark, d, "events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return series.interpolated(e, "v", ["user_id"], "p").select("event_id", _r("v_filled").alias("filled"))


@_query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT user_id, p, sum(value) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b, count(value) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c FROM e)
SELECT user_id, round(greatest(coalesce(max(CASE WHEN c = 3 THEN b - low END), 0), 0), 6) AS best_spread
FROM (SELECT *, min(CASE WHEN c = 3 THEN b END) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS low FROM s) GROUP BY user_id""")
def best_trade(spark, d):
    """L5."""
    from pyspark.sql import Window

    e = _read(spark, d, "events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return _rounded(settle.best_block(e, ["user_id"], "p", "value", 3))


@_query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value, hour(ts) AS h FROM events)
SELECT user_id, day, round(sum(value * (CASE WHEN h >= 16 THEN 1 ELSE 0 END - CASE WHEN h < 8 THEN 1 ELSE 0 END)) * 0.5, 6) AS revenue,
 round(count(CASE WHEN h >= 16 THEN 1 END) * 0.5, 6) AS mwh FROM e GROUP BY ALL""", "day")
def settlement(spark, d):
    """L3."""
    e = _read(spark, d, "events").withColumns({"day": F.col("ts").cast("date"), "charge_mw": (F.hour("ts") < 8).cast("double"), "discharge_mw": (F.hour("ts") >= 16).cast("double")})
    return _rounded(settle.settle(e, ["user_id", "day"], "value", 2.0, 0.5, 5.0).select("user_id", "day", "revenue", "mwh"))


@_query("""WITH h AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price, TIMESTAMP '2024-01-01' AS valid_from FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 7 <> 0)
SELECT h.o_orderkey, h.o_orderstatus, h.price, valid_from, CASE WHEN c.o_orderkey IS NULL OR h.o_orderstatus <> c.o_orderstatus THEN TIMESTAMP '2024-02-01' END AS valid_to FROM h LEFT JOIN c USING (o_orderkey)
UNION ALL SELECT c.*, TIMESTAMP '2024-02-01', NULL FROM c LEFT JOIN h USING (o_orderkey) WHERE h.o_orderkey IS NULL OR h.o_orderstatus <> c.o_orderstatus""")
def history_of_orders(spark, d):
    """A23."""
    o = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus", _r("o_totalprice", 2).alias("price"))
    h = o.filter("o_orderkey % 5 <> 0").withColumns({"valid_from": F.lit("2024-01-01").cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    c = o.filter("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    return lake.scd2(h, c, "o_orderkey", ["o_orderstatus", "price"], "2024-02-01 00:00:00")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS version, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 <> 0""")
def keyed_upsert(spark, d):
    """A15, G2."""
    o = _read(spark, d, "orders").select("o_orderkey", F.lit("old").alias("version"), _r("o_totalprice", 2).alias("price"))
    return lake.upserted(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 4 = 0").withColumn("version", F.lit("new")), ["o_orderkey"], ["version", "price"])


@_query("""SELECT 'o_orderstatus' AS column_name, count(CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 11 = 0 THEN 1 END) AS mismatches FROM orders
UNION ALL SELECT 'o_totalprice', count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) FROM orders""")
def compared_tables(spark, d):
    """G5."""
    o = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = o.filter("o_orderkey % 11 <> 0").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(F.col("o_orderstatus")), "o_totalprice": F.col("o_totalprice") * (1 + 1e-12)})
    return series.table_diff(o, other, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@_query("""SELECT 'unique' AS contract, 'error' AS severity, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations, true AS failed
UNION ALL SELECT 'range', 'warn', (SELECT count(*) FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 200000), false
UNION ALL SELECT 'values', 'warn', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')), false
UNION ALL SELECT 'parent', 'warn', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)), false
UNION ALL SELECT 'known', 'error', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL), false""")
def contract_summary(spark, d):
    """K1, K2, K4 to K6, K12."""
    o, c = _read(spark, d, "orders"), _read(spark, d, "customer").filter("c_acctbal > 0")
    return contracts.summary({"unique": (contracts.unique(o, ["o_custkey"]), "error"), "range": (contracts.accepted_range(o, "o_totalprice", 1000, 200000), "warn"), "values": (contracts.accepted_values(o, "o_orderstatus", ["O", "F"]), "warn"), "parent": (contracts.relationships(o, "o_custkey", c, "c_custkey"), "warn"), "known": (contracts.not_null(o, "o_orderkey"), "error")})


@_query("""SELECT event_type, max(ts) AS latest, round(date_sub('second', max(ts), TIMESTAMP '2024-01-31') / 3600.0, 6) AS age_hours,
 CASE WHEN date_sub('second', max(ts), TIMESTAMP '2024-01-31') / 3600.0 > 48 THEN 'error' WHEN date_sub('second', max(ts), TIMESTAMP '2024-01-31') / 3600.0 > 24 THEN 'warn' ELSE 'pass' END AS state FROM events GROUP BY ALL""")
def source_freshness(spark, d):
    """K13, D35."""
    return _rounded(contracts.freshness(_read(spark, d, "events"), "ts", "2024-01-31 00:00:00", 24, 48, ["event_type"]))


@_query("""SELECT l_returnflag, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def top_lines(spark, d):
    """a top-k report."""
    li = _read(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice")
    return serve.top_by(li, ["l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5).select("l_returnflag", "l_orderkey", "l_linenumber", _r("l_extendedprice", 2).alias("price"), F.col("rank").cast("long").alias("rank"))


@_query("""PIVOT (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, o_totalprice FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING round(sum(o_totalprice), 2) GROUP BY month""", "month")
def monthly_pivot(spark, d):
    """D32."""
    o = _read(spark, d, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    return o.groupBy("month").pivot("o_orderstatus", ["F", "O", "P"]).agg(_r(F.sum("o_totalprice"), 2))


@_query("""SELECT CAST(CAST(o_orderdate AS DATE) - CAST(((CAST(o_orderdate AS DATE) - DATE '2000-01-01') % 7 + 7) % 7 AS INTEGER) AS DATE) AS chunk, count(*) AS n FROM orders GROUP BY ALL""", "chunk")
def aligned_chunks(spark, d):
    """H17."""
    return _read(spark, d, "orders").groupBy(t.chunk_start(F.col("o_orderdate").cast("date"), 7).alias("chunk")).agg(F.count("*").alias("n"))
