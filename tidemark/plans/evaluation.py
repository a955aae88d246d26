"""Queries on forecasts, contracts, settlement and read models (D13 to D19, D29, J, K, L, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.functions import timeutil as t
from tidemark.operators import contracts, folds, forecasts, mart, series, settle
from tidemark.operators.calendar import settlement_calendar
from tidemark.plans import serve
from tidemark.plans.catalogue import _FORECASTS, _constant, _forecasts, _lines, _quantiles
from tidemark.plans.registry import HALF_HOURS, ZONE, half_hours, query, r, read, rounded
from tidemark.sources.staging import staged

HOURS = {"night": (0, 6), "morning": (6, 12), "afternoon": (12, 18), "evening": (18, 24)}


def _folds(spark, d, near: tuple[str, ...] = (), quantiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return _forecasts(spark, d, near, quantiles).withColumns({"day": F.col("l_shipdate").cast("date"), "fold": t.quarter_label("l_shipdate")})


_FOLDS = f"{_FORECASTS}, x AS (SELECT *, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS fold FROM l)"


@query(f"""WITH {_FOLDS} SELECT fold, model, count(*) AS n, round(avg(loss), 4) AS pinball, round(avg(abs(p50 - y)), 4) AS mae, round(avg(CAST(y BETWEEN p10 AND p90 AS INTEGER)), 6) AS coverage, round(avg(CAST(y <= p90 AS INTEGER)), 6) AS share_below_p90 FROM x GROUP BY ALL""")
def fold_metrics(spark, d):
    """D13, D11."""
    out = forecasts.fold_metrics(_folds(spark, d))
    return out.select("fold", "model", "n", r("pinball", 4).alias("pinball"), r("mae", 4).alias("mae"), r("coverage").alias("coverage"), r("share_below_p90").alias("share_below_p90"))


def _gain(spark, d, quantiles: tuple[DataFrame, DataFrame]) -> DataFrame:
    f = _folds(spark, d, ("l_orderkey", "l_linenumber"), quantiles).withColumn("loss", m.mean_pinball("y", [0.1, 0.5, 0.9]))
    pairs = mart.wide_with_actual(f, ["l_orderkey", "l_linenumber", "day"], "model", ["constant", "by_quantity"], "loss", "y")
    return m.paired_gain(pairs.withColumn("fold", t.quarter_label("day")), "constant", "by_quantity", "day", "fold")


_GAIN = f"""{_FOLDS}, k AS (SELECT l_orderkey, l_linenumber, fold, day, avg(loss) FILTER (model = 'constant') AS b, avg(loss) FILTER (model = 'by_quantity') AS o FROM x GROUP BY ALL),
w AS (SELECT fold, day, avg(b - o) AS gain, avg(b) AS base FROM k GROUP BY ALL),
g AS (SELECT fold, avg(gain) AS fold_gain, sum(gain) AS s, sum(base) AS b, count(*) AS d FROM w GROUP BY 1),
gain AS (SELECT sum(s) / sum(d) AS mean_gain, sum(s) / nullif(sum(b), 0) AS relative_gain, count(CASE WHEN fold_gain > 0 THEN 1 END) AS folds_won, count(*) AS folds FROM g)"""


@query(f"""WITH {_GAIN} SELECT round(mean_gain, 4) AS mean_gain, round(relative_gain, 6) AS relative_gain, folds_won, folds, mean_gain > 0 AND folds_won >= 9 AND c BETWEEN 0.77 AND 0.83 AS adopted
 FROM gain, (SELECT avg(CAST(y BETWEEN p10 AND p90 AS INTEGER)) AS c FROM x WHERE model = 'by_quantity')""")
def paired_verdict(spark, d):
    """Gain of one model over another by day and fold, and whether it is adopted (with the mean as its lower limit)."""
    quantiles = _quantiles(_lines(spark, d))
    c = _folds(spark, d, quantiles=quantiles).filter("model = 'by_quantity'").agg(F.avg(m.interval("y", "p10", "p90")).alias("_c"))
    out = forecasts.verdict(_gain(spark, d, quantiles).join(F.broadcast(c)), F.col("mean_gain"), F.col("_c")).drop("_c")
    return out.select(r("mean_gain", 4).alias("mean_gain"), r("relative_gain").alias("relative_gain"), "folds_won", "folds", "adopted")


@query(f"""WITH {_FOLDS}, g AS (SELECT day, avg(loss) FILTER (model = 'constant') - avg(loss) FILTER (model = 'by_quantity') AS gain FROM x GROUP BY 1),
p AS (SELECT row_number() OVER (ORDER BY day) AS i, sum(gain) OVER (ORDER BY day) AS s FROM g WHERE gain IS NOT NULL UNION ALL SELECT 0, 0),
n AS (SELECT max(i) AS n FROM p), d AS (SELECT repeat, k, n, CAST('0x' || substr(md5('0-' || repeat || '-' || k), 1, 8) AS BIGINT) % greatest(n - 6, 1) AS a
  FROM n, (SELECT unnest(range(500)) AS repeat), LATERAL (SELECT unnest(range(CAST(ceil(n / 7) AS BIGINT))) AS k)),
m AS (SELECT repeat, sum(y.s - x.s) / any_value(n) AS m FROM d JOIN p x ON x.i = a JOIN p y ON y.i = a + least(7, n - 7 * k) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def gain_interval(spark, d):
    """Limits of the mean daily gain over resampled blocks of days."""
    f = _folds(spark, d).withColumn("loss", m.mean_pinball("y", [0.1, 0.5, 0.9]))
    daily = f.groupBy("day").agg((F.avg(F.when(F.col("model") == "constant", F.col("loss"))) - F.avg(F.when(F.col("model") == "by_quantity", F.col("loss")))).alias("gain"))
    return rounded(m.block_bootstrap(daily, "gain", "day", repeats=500), 4)


@query(f"""WITH {_FOLDS}, dd AS (SELECT model, day, count(*) AS n, avg(loss) AS pinball, avg(CAST(y BETWEEN p10 AND p90 AS INTEGER)) AS coverage FROM x GROUP BY ALL)
SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(pinball * n) / sum(n), 4) AS pinball, round(sum(coverage * n) / sum(n), 6) AS coverage, count(DISTINCT day) AS days FROM dd GROUP BY 1""")
def record_totals(spark, d):
    """Daily metrics pooled by their rows."""
    daily = _folds(spark, d).groupBy("model", "day").agg(*m.metric_columns())
    out = serve.totals(daily)
    return out.select("model", F.col("n").cast("long").alias("n"), r("pinball", 4).alias("pinball"), r("coverage").alias("coverage"), "days")


@query(f"""WITH {_FOLDS}, dd AS (SELECT model, day, avg(CAST(y BETWEEN p10 AND p90 AS INTEGER)) AS coverage FROM x GROUP BY ALL)
SELECT model, day, round(CASE WHEN count(coverage) OVER w >= 15 THEN avg(coverage) OVER w END, 6) AS coverage_rolling FROM dd WINDOW w AS (PARTITION BY model ORDER BY day ROWS 29 PRECEDING)""", "day")
def coverage_over_time(spark, d):
    """M3, E5."""
    daily = _folds(spark, d).groupBy("model", "day").agg(F.avg(m.interval("y", "p10", "p90")).alias("coverage"))
    return rounded(serve.coverage_over_time(daily, 30).select("model", "day", "coverage_rolling"))


@query(f"""WITH {_FOLDS} SELECT model, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, day, round(p50, 4) AS p50, round(y, 2) AS y FROM x WHERE day BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND model = 'by_quantity'""", "day")
def forecast_range(spark, d):
    """M2: a month of forecasts of one model with actuals."""
    out = serve.between_days(_folds(spark, d), "day", "1997-03-01", "1997-03-31", model="by_quantity")
    return out.select("model", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "day", r("p50", 4).alias("p50"), r("y", 2).alias("y"))


@query(f"""WITH {_FOLDS}, a AS (SELECT model, avg(loss) AS loss FROM x GROUP BY 1) SELECT model, round(loss, 4) AS loss, round(1 - loss / nullif(max(CASE WHEN model = 'constant' THEN loss END) OVER (), 0), 6) AS skill FROM a""")
def leaderboard(spark, d):
    """F8, C26."""
    a = _folds(spark, d).groupBy("model").agg(F.avg(m.mean_pinball("y", [0.1, 0.5, 0.9])).alias("loss"))
    return forecasts.leaderboard(a, "loss", "constant").select("model", r("loss", 4).alias("loss"), r("skill").alias("skill"))


@query("""WITH p AS (SELECT 'live' AS origin, o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT origin, k, round(v, 2) AS v FROM p UNION ALL SELECT 'backtest', k, round(v, 2) FROM b WHERE k NOT IN (SELECT k FROM p)""")
def preferred_rows(spark, d):
    """M1, M5: live rows, and others where there are none."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    top = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    return rounded(serve.preferred(top(o.filter("o_orderkey % 3 = 0")), top(o), ["k"]), 2)


@query("""SELECT 'orders' AS output, count(*) > 0 AS present, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS latest, arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) AS version FROM orders
UNION ALL SELECT 'late', count(*) > 0, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR), arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) FROM orders WHERE o_orderdate > TIMESTAMP '2010-01-01'""")
def output_health(spark, d):
    """M7."""
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", F.col("o_orderstatus").alias("version"))
    return serve.health({"orders": o, "late": o.filter("day > DATE'2010-01-01'")}, "day", "version", ["o_orderkey"])


@query(f"""WITH {HALF_HOURS}, f AS (SELECT *, h.price AS y, avg(price) OVER (PARTITION BY day) * 0.8 AS p10, avg(price) OVER (PARTITION BY day) AS p50, avg(price) OVER (PARTITION BY day) * 1.2 AS p90, CASE WHEN hour(start_utc) < 6 THEN 'night' WHEN hour(start_utc) < 12 THEN 'morning' WHEN hour(start_utc) < 18 THEN 'afternoon' ELSE 'evening' END AS g FROM h)
SELECT g AS "group", count(*) AS n, round(avg(CAST(y BETWEEN p10 AND p90 AS INTEGER)), 6) AS coverage, round(avg(CAST(y < p10 AS INTEGER)), 6) AS below, round(avg(CAST(y > p90 AS INTEGER)), 6) AS above, round(avg(abs(y - p50)), 6) AS mae FROM f WHERE y IS NOT NULL GROUP BY 1""")
def errors_by_hours(spark, d):
    """D29, F6, H16."""
    mean = series.deviation("price", ["day"])
    f = half_hours(spark, d).withColumn("p50", F.col("price") - mean).withColumns({"p10": F.col("p50") * 0.8, "p90": F.col("p50") * 1.2})
    return rounded(series.errors_by_group(f, "price", "p10", "p50", "p90", t.hour_group(F.hour("start_utc"), HOURS), list(HOURS)))


_ORDER_DAYS = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS y, o_custkey % 4 AS g, CAST(o_custkey AS DOUBLE) AS x FROM orders)"


def _order_days(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 4).alias("g"), F.col("o_custkey").cast("double").alias("x"))


_SPAN = "span AS (SELECT date_trunc('month', min(day)) + INTERVAL 12 MONTH AS a, max(day) AS b FROM o), folds AS (SELECT strftime(g, '%Y-%m') AS fold, CAST(g AS DATE) AS test_start, least(last_day(g), b) AS test_end, CAST(g AS DATE) - 2 AS train_end FROM (SELECT b, unnest(generate_series(a, CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS g FROM span))"


def _month_folds(spark, o: DataFrame) -> DataFrame:
    """Folds from the second year of the table to its last day."""
    s = o.agg(F.add_months(F.trunc(F.min("day"), "month"), 12).cast("string").alias("a"), F.max("day").cast("string").alias("b")).first()
    return forecasts.monthly_folds(spark, s.a, s.b)


@query(f"""WITH {_ORDER_DAYS}, {_SPAN} SELECT fold, train_end, count(CASE WHEN day <= train_end AND day > train_end - 365 THEN 1 END) AS n_train, count(CASE WHEN day BETWEEN test_start AND test_end THEN 1 END) AS n_test FROM folds, o GROUP BY ALL""", "train_end")
def rolling_folds(spark, d):
    """Every month from the second year on, trained on the year before."""
    o = _order_days(spark, d).select("day")
    sums = folds.day_prefixes(o, "day", {"n": F.lit(1)})
    out = folds.fold_sums(_month_folds(spark, o), sums, ["n"], last_days=365)
    return out.select("fold", "train_end", F.col("train_n").cast("long").alias("n_train"), F.col("test_n").cast("long").alias("n_test"))


_PAIRS = f"""{_ORDER_DAYS}, {_SPAN}, e AS (SELECT fold, train_end, test_start, test_end, day, x, y, {{weight}} AS w FROM folds JOIN o ON day <= train_end {{window}} AND x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT fold, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM e GROUP BY 1),
b AS (SELECT fold, n, mx, my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope FROM e JOIN g USING (fold) GROUP BY ALL)"""


@query(f"""WITH {_PAIRS.format(weight="1.0", window="AND day > train_end - 365")} SELECT fold, round(CAST(n AS DOUBLE), 3) AS n, round(slope, 4) AS slope, round(my - slope * mx, 1) AS intercept FROM b""")
def linear_folds(spark, d):
    """A line per month through the orders of the year before, all from one set of sums."""
    o = _order_days(spark, d)
    out = folds.linear_folds(o, _month_folds(spark, o), ["x"], "y", "day", last_days=365)
    return out.filter("n > 0").select("fold", r("n", 3).alias("n"), r(F.col("beta")[0], 4).alias("slope"), r("intercept", 1).alias("intercept"))


@query(f"""WITH {_PAIRS.format(weight="power(0.5, (train_end - day) / 90.0)", window="")}, p AS (SELECT fold, o_orderkey, y, my + slope * (x - mx) AS point FROM b JOIN folds USING (fold) JOIN o ON day BETWEEN test_start AND test_end)
SELECT fold, count(*) AS n, round(any_value(slope), 4) AS slope, round(avg(abs(y - point)), 2) AS mae FROM p JOIN b USING (fold) GROUP BY 1""")
def recency_folds(spark, d):
    """As linear_folds over all that came before, weights halving every 90 days back, and the error in the month that follows."""
    o = _order_days(spark, d)
    months = _month_folds(spark, o)
    models = staged(folds.linear_folds(o, months, ["x"], "y", "day", half_life=90.0), "models")
    out = folds.predicted(folds.tested(o, months, "day"), models, ["x"]).groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("point"))).alias("mae"))
    return out.join(models.drop("n"), "fold").select("fold", "n", r(F.col("beta")[0], 4).alias("slope"), r("mae", 2).alias("mae"))


@query(f"""WITH {_ORDER_DAYS}, c AS (SELECT *, max(day) OVER () - 29 AS cut FROM o), tr AS (SELECT *, max(day) OVER () - 55 AS cal FROM c WHERE day < cut),
m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM tr WHERE day < cal - 2), q AS (SELECT quantile_cont(y - i - s * x, 0.1) AS a, quantile_cont(y - i - s * x, 0.5) AS b, quantile_cont(y - i - s * x, 0.9) AS c FROM tr, m WHERE day >= cal)
SELECT o_orderkey, round(i + s * x, 1) AS point, round(i + s * x + a, 1) AS p10, round(i + s * x + b, 1) AS p50, round(i + s * x + q.c, 1) AS p90 FROM c, m, q WHERE day >= cut""")
def residual_quantiles(spark, d):
    """The last 30 days by a line from all before, with quantiles of its errors on 56 days that the line has not seen."""
    o = _order_days(spark, d)
    train, test = forecasts.latest_fold(o, "day", "y", 30, gap_days=1)
    out = forecasts.residual_forecast(train, test, ["x"], "y", "day", [0.1, 0.5, 0.9])
    return out.select("o_orderkey", *[r(c, 1).alias(c) for c in ("point", "p10", "p50", "p90")])


@query(f"""WITH {_ORDER_DAYS}, g AS (SELECT o_orderkey, day, CASE WHEN o_orderkey % 5 > 0 THEN x END AS x, CASE WHEN o_orderkey % 500 > 0 THEN y END AS y FROM o), t AS (SELECT * FROM g WHERE day < (SELECT max(day) FROM g) - 100),
m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM t), s AS (SELECT avg(coalesce(x, mx)) AS ax, stddev_samp(coalesce(x, mx)) AS dx, avg(coalesce(y, my)) AS ay, stddev_samp(coalesce(y, my)) AS dy FROM t, m)
SELECT o_orderkey, round((coalesce(x, mx) - ax) / dx, 6) AS x_z, round((coalesce(y, my) - ay) / dy, 6) AS y_z, CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x_missing FROM g, m, s""")
def linear_design(spark, d):
    """Features with medians filled in, standardised, and an indicator for the one that is often missing, all from what lies 100 days back."""
    o = _order_days(spark, d).withColumns({"x": F.when(F.col("o_orderkey") % 5 > 0, F.col("x")), "y": F.when(F.col("o_orderkey") % 500 > 0, F.col("y"))})
    last = o.agg(F.date_sub(F.max("day"), 100).alias("_cut"))
    train = o.crossJoin(F.broadcast(last)).filter(F.col("day") < F.col("_cut"))
    out, names = forecasts.linear_design(train, o, ["x", "y"])
    return rounded(out.select("o_orderkey", *names))


@query(f"""WITH {_ORDER_DAYS}, k AS (SELECT year(day) AS year, month(day) >= 7 AS later, x FROM o), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY x) + (count(*) OVER (PARTITION BY year, x) - 1) / 2.0 AS a FROM k)
SELECT CAST(year AS BIGINT) AS year, round((sum(a) FILTER (later) - count(*) FILTER (later) * (count(*) FILTER (later) + 1) / 2.0) / nullif(count(*) FILTER (later) * count(*) FILTER (NOT later), 0), 6) AS auc, count(*) FILTER (later) AS positives, count(*) FILTER (NOT later) AS negatives FROM r GROUP BY 1""")
def score_auc(spark, d):
    """How well a given score tells the halves of a year apart."""
    rows = _order_days(spark, d).select(F.year("day").alias("year"), (F.month("day") >= 7).alias("later"), "x")
    return rounded(series.auc(rows, "x", "later", ["year"]))


@query(f"""WITH {_ORDER_DAYS}, {_SPAN}, a AS (SELECT fold, train_end, test_start, max(CAST(day AS TIMESTAMP)) + INTERVAL 30 MINUTE AS train_until FROM folds JOIN o ON day <= train_end + CASE WHEN fold LIKE '%-03' THEN 3 ELSE 0 END GROUP BY ALL)
SELECT fold, train_until, CAST(test_start AS TIMESTAMP) - INTERVAL 15 HOUR AS first_cutoff FROM a JOIN (SELECT DISTINCT fold FROM folds JOIN o ON day = test_start) USING (fold) WHERE train_until > CAST(test_start AS TIMESTAMP) - INTERVAL 15 HOUR""")
def leaking_folds(spark, d):
    """Folds trained past their first cutoff; those of March are made to leak."""
    o = _order_days(spark, d).select("day").distinct()
    months = _month_folds(spark, o)
    late = months.withColumn("train_end", F.when(F.col("fold").endswith("-03"), F.date_add("train_end", 3)).otherwise(F.col("train_end")))
    train, _ = forecasts.fold_rows(o, late, "day")
    _, test = forecasts.fold_rows(o.withColumn("cutoff", F.col("day").cast("timestamp_ntz") - F.expr("INTERVAL 15 HOUR")), months.withColumn("test_end", F.col("test_start")), "day")
    return forecasts.leaking_folds(train.withColumn("start", F.col("day").cast("timestamp_ntz")), test, "start", "cutoff")


_NAIVE = f"""{_ORDER_DAYS}, c AS (SELECT *, max(day) OVER () - 59 AS cut FROM o), tr AS (SELECT *, y - x AS res FROM c WHERE day < cut),
off AS (SELECT g, quantile_cont(res, 0.1) AS a, 0.0 AS b, quantile_cont(res, 0.9) AS c FROM tr GROUP BY 1)"""


@query(f"""WITH {_NAIVE}, p AS (SELECT o_orderkey, list_sort([x + coalesce(off.a, 0), x + coalesce(off.b, 0), x + coalesce(off.c, 0)]) AS q FROM c LEFT JOIN off USING (g) WHERE day >= cut)
SELECT o_orderkey, round(q[1], 4) AS p10, round(q[2], 4) AS p50, round(q[3], 4) AS p90 FROM p""")
def naive_forecast(spark, d):
    """Residual quantiles per group before the last 60 days, applied to these."""
    o = _order_days(spark, d)
    train, test = forecasts.latest_fold(o, "day", "y", 60, gap_days=1)
    point = F.coalesce("x", F.lit(0.0))
    off = forecasts.naive_fit(train, "y", point, "g", [0.1, 0.5, 0.9], [])
    out = forecasts.naive_predict(test, off, point, "g", [0.1, 0.5, 0.9], [])
    return rounded(out.select("o_orderkey", "p10", "p50", "p90"), 4)


@query(f"""WITH {_ORDER_DAYS}, c AS (SELECT *, max(day) OVER () - 55 AS cut FROM o), f AS (SELECT quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM c WHERE day < cut - 2),
k AS (SELECT g, y, f.* FROM c, f WHERE day >= cut), al AS (SELECT quantile_cont(y - p10, 0.1) AS a, quantile_cont(y - p50, 0.5) AS b, quantile_cont(y - p90, 0.9) AS c FROM k),
gr AS (SELECT g, quantile_cont(y - p10, 0.1) AS a, quantile_cont(y - p50, 0.5) AS b, quantile_cont(y - p90, 0.9) AS c FROM k WHERE g <> 3 GROUP BY 1)
SELECT o.g, round(p10 + coalesce(gr.a, al.a), 4) AS p10, round(p50 + coalesce(gr.b, al.b), 4) AS p50, round(p90 + coalesce(gr.c, al.c), 4) AS p90 FROM (SELECT DISTINCT g FROM o) o CROSS JOIN f CROSS JOIN al LEFT JOIN gr USING (g)""")
def calibrated_by_group(spark, d):
    """Shifts from the last 56 days after a gap, by group where it has any, else of all."""
    o = _order_days(spark, d)
    fit, cal = forecasts.calibration_split(o, "day")
    q = F.broadcast(series.exact_quantiles(fit, "y", [], [0.1, 0.5, 0.9]).toDF("p10", "p50", "p90"))
    cal = cal.crossJoin(q)
    shifts = forecasts.conformal_shifts(cal.withColumn("one", F.lit(1)), "y", [0.1, 0.5, 0.9], ["one"])
    own = forecasts.conformal_shifts(cal.filter("g <> 3").withColumn("one", F.lit(1)), "y", [0.1, 0.5, 0.9], ["one", "g"])
    rows = o.select("g", F.lit(1).alias("one")).distinct().crossJoin(q)
    return rounded(forecasts.shifted(rows, shifts, [0.1, 0.5, 0.9], ["one"], "g", own).select("g", "p10", "p50", "p90"), 4)


@query(f"""WITH {_FOLDS}, j AS (SELECT * FROM x WHERE day > DATE '1997-06-03'), w AS (SELECT l_orderkey, l_linenumber, avg(loss) FILTER (model = 'constant') AS a, avg(loss) FILTER (model = 'by_quantity') AS b FROM j GROUP BY ALL)
SELECT count(*) AS n, round(avg(a), 4) AS champion, round(avg(b), 4) AS challenger, count(*) >= 100 AND avg(b) < avg(a) AS promote FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def promotion(spark, d):
    """Champion and challenger on rows that neither has been trained on."""
    f = forecasts.judgement_rows(_folds(spark, d), {"champion": "1997-06-01", "challenger": "1997-05-01"}, "day")
    f = f.withColumns({"row_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "model": F.when(F.col("model") == "constant", "champion").otherwise("challenger")})
    out = forecasts.promotion(f, "y", [0.1, 0.5, 0.9], 100)
    return out.select("n", r("champion", 4).alias("champion"), r("challenger", 4).alias("challenger"), "promote")


@query(f"""WITH {_FORECASTS}, v AS (SELECT 'honest' AS features, y, p10, p50, p90 FROM f WHERE model = 'constant' UNION ALL SELECT 'late', y, p10 + (y - p10) / 2, p50 + (y - p50) / 2, p90 + (y - p90) / 2 FROM f WHERE model = 'constant'),
a AS (SELECT features, count(*) AS n, avg((greatest(0.1 * (y - p10), -0.9 * (y - p10)) + greatest(0.5 * (y - p50), -0.5 * (y - p50)) + greatest(0.9 * (y - p90), -0.1 * (y - p90))) / 3) AS p FROM v GROUP BY 1)
SELECT features, n, round(p, 4) AS pinball, round(1 - p / max(CASE WHEN features = 'honest' THEN p END) OVER (), 6) AS flattery FROM a""")
def leakage_cost(spark, d):
    """A forecast that has seen half of the actual value beside an honest one."""
    f = _constant(spark, d)
    late = f.withColumns({c: F.col(c) + (F.col("y") - F.col(c)) / 2 for c in ("p10", "p50", "p90")})
    out = forecasts.leakage_cost({"honest": f, "late": late}, "honest")
    return out.select("features", "n", r("pinball", 4).alias("pinball"), r("flattery").alias("flattery"))


@query(f"""WITH {_FOLDS}, p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, avg(p50) FILTER (model = 'constant') AS constant, avg(p50) FILTER (model = 'by_quantity') AS by_quantity, max(y) AS y FROM x GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(constant, 6) AS constant, round(by_quantity, 6) AS by_quantity, round(y, 2) AS y, round(o_totalprice, 2) AS total FROM p JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'""")
def settled_forecasts(spark, d):
    """One column per model beside the actual, of orders that are settled."""
    wide = mart.wide_with_actual(_folds(spark, d, ("l_orderkey",)), ["l_orderkey", "l_linenumber"], "model", ["constant", "by_quantity"], "p50", "y")
    o = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"))
    out = mart.settled(wide, o, ["l_orderkey"])
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), r("constant", 6).alias("constant"), r("by_quantity", 6).alias("by_quantity"), r("y", 2).alias("y"), r("total", 2).alias("total"))


@query(None)
def period_classifier(spark, d):
    """Whether a classifier tells the later half of all orders from the earlier, by blocks of months that it has not seen (a learned model: no SQL; score_auc says the area)."""
    o = _order_days(spark, d)
    span = o.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    o = o.crossJoin(F.broadcast(span)).withColumn("later", F.date_diff("day", "a") * 2 > F.date_diff("b", "a"))
    o = o.withColumns({"month": F.month("day"), "block": forecasts.block_of_months("day", 3, 3)}).select("o_orderkey", "later", "block", "y", "x", "month")
    scored = forecasts.cross_fitted(o, ["y", "x", "month"], "later", "block", 3, maxIter=5)
    return forecasts.separability(scored, "later", [])


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 > 0 THEN CAST(user_id AS VARCHAR) END AS user_id, event_type FROM events) GROUP BY ALL HAVING count(*) > 1""")
def repeated_combinations(spark, d):
    """Keys found more than once, null ones among them."""
    ev = read(spark, d, "events").select(F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("user_id"), "event_type")
    return contracts.unique_combination(ev.withColumn("user_id", F.col("user_id").cast("string")), ["user_id", "event_type"])


@query("""WITH d AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + 300, INTERVAL 1 DAY)) AS DATE) AS day FROM events),
n AS (SELECT day, CASE WHEN day = DATE '2024-03-31' THEN 46 WHEN day = DATE '2024-10-27' THEN 50 ELSE 48 END AS expected FROM d)
SELECT day, CAST(expected - 1 AS BIGINT) AS n, CAST(expected AS BIGINT) AS expected FROM n WHERE dayofyear(day) % 7 = 0""", "day")
def broken_calendar(spark, d):
    """Days of a calendar, over both clock changes, from which a half-hour has been taken away."""
    s = read(spark, d, "events").agg(F.min("ts").cast("date").cast("string").alias("a"), F.date_add(F.max("ts").cast("date"), 300).cast("string").alias("b")).first()
    cal = settlement_calendar(spark, s.a, s.b, ZONE).filter("not (day_of_year % 7 = 0 and period = 5)")
    return contracts.clock_changes(cal, ZONE).select("day", F.col("n").cast("long").alias("n"), F.col("expected").cast("long").alias("expected"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE) + 1, CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events)
SELECT count(*) AS n_after_cutoff FROM u, d JOIN events e ON e.ts > CAST(day AS TIMESTAMP) - INTERVAL 15 HOUR WHERE e.user_id = u.user_id AND e.event_type = 'purchase'""")
def guard_exercised(spark, d):
    """How many purchases came after a cutoff and so could have leaked into the mart."""
    ev = read(spark, d, "events")
    days = ev.agg(F.explode(F.sequence(F.date_add(F.min("ts").cast("date"), 1), F.max("ts").cast("date"))).alias("day")).withColumn("cutoff_utc", t.cutoff_utc("day", ZONE))
    spine = ev.select("user_id").distinct().crossJoin(days)
    return contracts.guard_exercised(spine, ev.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at")), ["user_id"], "at")


@query(f"""WITH {HALF_HOURS}, s AS (SELECT day, period, CAST(period <= 4 AS INTEGER) * 1.0 AS c, CASE WHEN period > 30 AND period <= 34 THEN 0.81 WHEN period = 40 AND day = (SELECT min(day) FROM h) THEN 0.5 ELSE 0 END AS d FROM h),
w AS (SELECT *, 0.5 * sum(c * 0.9 - d / 0.9) OVER (PARTITION BY day ORDER BY period) AS soc FROM s)
SELECT day, period, round(soc, 6) AS soc_mwh FROM w WHERE soc < -1e-6""", "day")
def infeasible_periods(spark, d):
    """A schedule that sells more than is stored on the first day."""
    from pyspark.sql import Window

    h = half_hours(spark, d)
    first = h.agg(F.min("day").alias("_first"))
    h = h.join(F.broadcast(first))
    extra = F.when((F.col("period") == 40) & (F.col("day") == F.col("_first")), 0.5).otherwise(0.0)
    s = h.select("day", "period", (F.col("period") <= 4).cast("double").alias("charge_mw"), F.when(F.col("period").between(31, 34), 0.81).otherwise(extra).alias("discharge_mw"))
    soc = F.sum(0.5 * (F.col("charge_mw") * 0.9 - F.col("discharge_mw") / 0.9)).over(Window.partitionBy("day").orderBy("period"))
    bad = contracts.infeasible(s.withColumn("soc_mwh", soc), 1.0, 2.0, 0.9, 0.5, ["day"], "period", discharge_efficiency=0.9)
    return rounded(bad.filter("soc_mwh < -1e-6").select("day", "period", "soc_mwh"))


def _pnl(spark, d) -> DataFrame:
    h = half_hours(spark, d)
    windows = {"early": ((1, 4), (35, 38)), "late": ((5, 8), (21, 24))}
    rows = h.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col("period").between(*c).cast("double").alias("charge_mw"), F.col("period").between(*x).cast("double").alias("discharge_mw")) for n, (c, x) in windows.items()])))
    rows = rows.select("day", "period", "price", "s.*")
    daily = settle.settle(rows, ["day", "strategy"], "price", 2.0, 0.5, 1.0, discharge_efficiency=0.9)
    best = settle.best_block(h, ["day"], "period", "price", 4).select("day", (F.col("best_spread") * 0.5).alias("revenue"))
    best = best.withColumns({"degradation": F.lit(2.0), "mwh": F.lit(2.0), "net": F.col("revenue") - 2.0, "cycles": F.lit(2.0 / 0.9 / 2.0)})
    return settle.strategies_with_bound(daily, best, "best")


_PNL = f"""{HALF_HOURS}, s AS (SELECT day, price, period, unnest(['early', 'late']) AS strategy, unnest([CAST(period BETWEEN 1 AND 4 AS INTEGER), CAST(period BETWEEN 5 AND 8 AS INTEGER)]) AS c, unnest([CAST(period BETWEEN 35 AND 38 AS INTEGER), CAST(period BETWEEN 21 AND 24 AS INTEGER)]) AS x FROM h),
dl AS (SELECT day, strategy, sum(price * (x - c)) * 0.5 AS revenue, sum(x) * 0.5 AS mwh FROM s GROUP BY ALL),
b0 AS (SELECT day, period, sum(price) OVER w AS b, count(price) OVER w AS k FROM h WINDOW w AS (PARTITION BY day ORDER BY period ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
b1 AS (SELECT day, b, k, min(CASE WHEN k = 4 THEN b END) OVER (PARTITION BY day ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS low FROM b0),
al AS (SELECT day, strategy, revenue, mwh, revenue - mwh AS net, mwh / 0.9 / 2 AS cycles FROM dl UNION ALL SELECT day, 'best', 0.5 * greatest(coalesce(max(CASE WHEN k = 4 THEN b - low END), 0), 0), 2.0, 0.5 * greatest(coalesce(max(CASE WHEN k = 4 THEN b - low END), 0), 0) - 2.0, 2.0 / 0.9 / 2 FROM b1 GROUP BY day)"""


@query(f"""WITH {_PNL} SELECT day, strategy, round(revenue, 6) AS revenue, round(net, 6) AS net, round(cycles, 6) AS cycles, round(max(CASE WHEN strategy = 'best' THEN net END) OVER (PARTITION BY day) - net, 6) AS shortfall FROM al""", "day")
def daily_pnl(spark, d):
    """Daily results of two schedules and of the best block, with the shortfall from it."""
    return rounded(_pnl(spark, d).select("day", "strategy", "revenue", "net", "cycles", "shortfall"))


@query(f"""WITH {_PNL}, g AS (SELECT strategy, sum(revenue) AS revenue, sum(net) AS net, avg(cycles) AS cycles_a_day, count(DISTINCT day) AS days FROM al GROUP BY 1),
e AS (SELECT max(CASE WHEN strategy = 'best' THEN net END) AS top, max(CASE WHEN strategy = 'late' THEN net END) AS low FROM g)
SELECT strategy, round(revenue, 4) AS revenue, round(net, 4) AS net, round(cycles_a_day, 6) AS cycles_a_day, days, round(net / days * 365.25, 4) AS net_a_year, round(CASE WHEN top > 0 THEN net / top END, 6) AS capture, round(CASE WHEN top > low THEN (net - low) / (top - low) END, 6) AS gap_closed FROM g, e""")
def strategy_totals(spark, d):
    """D18, D19, L6."""
    out = m.strategy_totals(_pnl(spark, d), "best", "late")
    return out.select("strategy", *[r(c, 4).alias(c) for c in ("revenue", "net", "net_a_year")], *[r(c).alias(c) for c in ("cycles_a_day", "capture", "gap_closed")], "days")


@query(f"""WITH {_PNL} SELECT strategy, day, round(net, 6) AS net, round(sum(net) OVER (PARTITION BY strategy ORDER BY day), 4) AS net_cum FROM al""", "day")
def cumulative_pnl(spark, d):
    """M4: daily results and their running sum by strategy."""
    out = serve.cumulative_pnl(_pnl(spark, d))
    return out.select("strategy", "day", r("net").alias("net"), r("net_cum", 4).alias("net_cum"))


@query(f"""WITH {_PNL} SELECT al.day, al.strategy, round(al.net, 6) AS net FROM al JOIN (SELECT day, net FROM al WHERE strategy = 'late') b ON b.day = al.day WHERE al.strategy <> 'late' AND al.net > b.net + 1e-6""", "day")
def undominated(spark, d):
    """Results above those of a strategy taken as the bound."""
    return rounded(contracts.not_dominated(_pnl(spark, d), "late", ["day"], "net").select("day", "strategy", "net"))


@query(f"""WITH {HALF_HOURS}, x AS (SELECT day, period, CASE WHEN n % 7 > 0 THEN price END AS price FROM h), ok AS (SELECT day FROM x GROUP BY 1 HAVING count(*) IN (46, 48, 50) AND avg(CAST(price IS NOT NULL AS INTEGER)) >= 0.8),
k AS (SELECT x.*, last_value(price IGNORE NULLS) OVER a AS v0, first_value(price IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN price IS NOT NULL THEN period END IGNORE NULLS) OVER a AS p0, first_value(CASE WHEN price IS NOT NULL THEN period END IGNORE NULLS) OVER b AS p1 FROM x JOIN ok USING (day)
 WINDOW a AS (PARTITION BY day ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY day ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT day, period, coalesce(price, v0 + (v1 - v0) * (period - p0) / nullif(p1 - p0, 0), v0, v1) AS actual FROM k)
SELECT day, period, strategy, round(decision_price, 6) AS decision_price FROM (SELECT day, period, unnest(['bound', 'naive']) AS strategy, unnest([actual, avg(actual) OVER (PARTITION BY day)]) AS decision_price FROM f)""", "day")
def decision_prices(spark, d):
    """Whole days with gaps filled; the bound decides by actual prices, the naive strategy by a column without values, filled by the day's mean."""
    h = half_hours(spark, d).select("day", "period", F.when(F.col("n") % 7 > 0, F.col("price")).alias("price"))
    days = settle.prepared_days(h, "day", "period", "price", share=0.8).withColumnRenamed("price_filled", "actual").withColumn("naive", F.lit(None).cast("double"))
    days = settle.filled_decisions(days, ["day"], "period", ["naive"], "actual")
    return rounded(settle.decision_prices(days, {"bound": "actual", "naive": "naive"}).select("day", "period", "strategy", "decision_price"))
