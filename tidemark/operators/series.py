"""Windows over daily and half-hourly series, and their profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged


def weighted_mean(value: str, weight: str) -> Column:
    """Weights of null values don't count."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))


def ratio_of_sums(a: str, b: str) -> Column:
    """D3."""
    return F.sum(a) / F.nullif(F.sum(b), F.lit(0.0))


def conditional_sums(df: DataFrame, by: list[str], parts: dict[str, tuple[Column, Column]], more: list[Column] = ()) -> DataFrame:
    """Per group the sum of a value over the rows of each part, 0 where it has none, in one pass; name -> (condition, value). More aggregates may be added."""
    return df.groupBy(*by).agg(*[F.sum(F.when(cond, value).otherwise(F.lit(0.0))).alias(name) for name, (cond, value) in parts.items()], *more)


def distinct_of(columns: dict[str, str]) -> list[Column]:
    """Aggregates that count distinct values; name -> column."""
    return [F.countDistinct(c).alias(name) for name, c in columns.items()]


def lagged_mean(df: DataFrame, value: str, slot: list[str], day_number: str, days: int, lag: int = 2) -> DataFrame:
    """Mean of `days` days ending `lag` days before, per slot, with half of them (2 at least) known."""
    w = Window.partitionBy(*slot).orderBy(day_number).rangeBetween(-(days + lag - 1), -lag)
    return df.withColumn(f"{value}_mean_{days}d", F.when(F.count(value).over(w) >= max(2, days // 2), F.avg(value).over(w)))


def lagged_regression(df: DataFrame, y: str, x: str, by: list[str], day_number: str, days: int = 14, lag: int = 2, least: int = 7) -> DataFrame:
    """Slope, intercept and the value they imply for the row's x, from all rows of the days in a trailing window that ends `lag` days before.

    Sums are taken per day first (by, day), then over the window of days; there
    must be `least` days from the first on. A day without any pair counts as a day.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    part = lambda c: F.sum(F.when(both, c).otherwise(0.0))
    sums = {"_n": part(F.lit(1.0)), "_sx": part(F.col(x)), "_sy": part(F.col(y)), "_sxx": part(F.col(x) * F.col(x)), "_sxy": part(F.col(x) * F.col(y))}
    daily = df.groupBy(*by, day_number).agg(*[c.alias(k) for k, c in sums.items()])
    w = Window.partitionBy(*by).orderBy(day_number).rangeBetween(-(days + lag - 1), -lag)
    first = F.min(day_number).over(Window.partitionBy(*by).orderBy(day_number).rangeBetween(Window.unboundedPreceding, 0))
    daily = daily.withColumns({f"{k}w": F.sum(k).over(w) for k in sums} | {"_span": F.col(day_number) - lag - first + 1})
    n, sx, sy, sxx, sxy = (F.col(f"{k}w") for k in sums)
    spread = n * sxx - sx * sx
    enough = F.col("_span") >= least
    slope = F.when(enough & (spread > 0), (n * sxy - sx * sy) / spread)
    daily = daily.withColumn("slope", slope).withColumn("intercept", F.when(enough, (sy - F.col("slope") * sx) / F.nullif(n, F.lit(0.0))))
    back = daily.select(*[F.col(c).alias(f"_d{k}") for k, c in enumerate([*by, day_number])], "slope", "intercept")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_d{k}")) for k, c in enumerate([*by, day_number])])
    out = df.join(back, same, "left").drop(*[f"_d{k}" for k in range(len(by) + 1)])
    return out.withColumn("implied", F.col("intercept") + F.col("slope") * F.col(x))


def rolling_mean(df: DataFrame, value: str, by: list[str], order: list[str], rows: int) -> DataFrame:
    """E5: mean of the last rows, with half of them (1 at least) known."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(f"{value}_rolling", F.when(F.count(value).over(w) >= max(1, rows // 2), F.avg(value).over(w)))


def running(df: DataFrame, value: str, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Running sum, or with a weight the weighted mean so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if weight is None:
        return df.withColumn(f"{value}_cum", F.sum(value).over(w))
    return df.withColumn(f"{value}_to_date", F.sum(F.col(value) * F.col(weight)).over(w) / F.nullif(F.sum(weight).over(w), F.lit(0.0)))


#: Distinct values that one task puts in order.
PER_TASK = 1 << 20
#: Rows that one task aggregates after `dealt`.
DEALT = 1 << 19
#: Rows of a table that is broadcast beside others.
FEW = 1 << 16


def _same(by: list[str], other: str) -> Column:
    return reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_{other}{k}")) for k, b in enumerate(by)], F.lit(True))


def _renamed(df: DataFrame, by: list[str], other: str) -> DataFrame:
    return df.select(*[F.col(b).alias(f"_{other}{k}") for k, b in enumerate(by)], *[c for c in df.columns if c not in by])


def _places(quantiles) -> list[tuple[Column, Column]]:
    """First and last of the (one or two) places, from 0, between which each quantile of `total` values lies."""
    at = [(q if isinstance(q, Column) else F.lit(float(q))) * (F.col("total") - 1) for q in quantiles]
    return [(F.floor(x), F.ceil(x)) for x in at]


def counted_positions(counts: DataFrame, by: list[str], quantiles=None, per_task: int | None = None) -> DataFrame:
    """counts (by, _x, n), one row per group and distinct value, with before (rows of the group with less) and total.

    counts should be staged. Up to per_task values in all are put in order by
    group. More are dealt by range into tasks of about half as many, whatever
    their groups; only sums by task and group are added up, and values are
    put in order inside tasks. With quantiles, only the ranges that hold one.
    """
    per_task = per_task or PER_TASK
    group = Window.partitionBy(*by)
    less = Window.unboundedPreceding
    size = counts.count()
    if size <= per_task:
        before = F.sum("n").over(group.orderBy("_x").rowsBetween(less, -1))
        return counts.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(group)})
    dealt = staged(counts.repartitionByRange(-(-2 * size // per_task), *by, "_x").withColumn("_task", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*by, "_task").agg(F.sum("n").alias("_n"))
    ranges = ranges.withColumns({"_start": F.sum("_n").over(group.orderBy("_task").rowsBetween(less, 0)) - F.col("_n"), "total": F.sum("_n").over(group)})
    if quantiles is not None:
        inside = lambda x: (F.col("_start") <= x) & (x < F.col("_start") + F.col("_n"))
        ranges = ranges.filter(reduce(Column.__or__, [inside(x) for pair in _places(quantiles) for x in pair]))
    found = dealt.join(_renamed(ranges.drop("_n").withColumnRenamed("_task", "_t"), by, "r"), _same(by, "r") & (F.col("_task") == F.col("_t")))
    inner = Window.partitionBy(*by, "_task").orderBy("_x").rowsBetween(less, -1)
    more = [c for c in counts.columns if c not in (*by, "_x", "n")]
    return found.select(*by, "_x", "n", *more, (F.col("_start") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before"), "total")


def _counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    return staged(known.groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("n")), "counts")


def quantile_columns(quantiles) -> list[Column]:
    """Aggregates over counted_positions of a group: q0, q1, ..., exact and linear between neighbours. A quantile may be a column that is the same throughout a group."""
    out = []
    for k, (q, (first, last)) in enumerate(zip(quantiles, _places(quantiles), strict=True)):
        at = (q if isinstance(q, Column) else F.lit(float(q))) * (F.col("total") - 1)
        pick = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("_x")))
        low, high, share = pick(first), pick(last), F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(f"q{k}"))
    return out


def exact_quantiles(df: DataFrame, value: str, by: list[str], quantiles) -> DataFrame:
    """by, q0, q1, ... of each group that has values. df is read once; then values are counted, and no group has to fit a task."""
    counts = _counts(df.withColumn("_y", F.col(value).cast("double")), "_y", by)
    return counted_positions(counts, by, quantiles).groupBy(*by).agg(*quantile_columns(quantiles))


def _ranks(counts: DataFrame, by: list[str]) -> DataFrame:
    return counted_positions(counts, by).select(*by, "_x", (F.col("before") + (F.col("n") + 1) / 2.0).alias("_rank"), "total")


def average_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Df with the rank of each row's value in its group, ties averaged; rows without value have null."""
    ranks = _renamed(_ranks(_counts(df, value, by), by).drop("total"), by, "b").withColumnsRenamed({"_x": "_rx", "_rank": name})
    return df.join(ranks, _same(by, "b") & (F.col(value) == F.col("_rx")), "left").drop("_rx", *[f"_b{k}" for k in range(len(by))])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of rows where both are known.

    Pairs of values are counted first and staged; ranks of both sides come from
    these counts. The mean rank is (total + 1) / 2 on either side.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = staged(known.groupBy(*by, F.col(x).alias("_vx"), F.col(y).alias("_vy")).agg(F.count("*").alias("m")), "pairs")
    for v in ("x", "y"):
        counts = staged(pairs.groupBy(*by, F.col(f"_v{v}").alias("_x")).agg(F.sum("m").alias("n")), "counts")
        ranks = _renamed(_ranks(counts, by), by, v).withColumnsRenamed({"_x": f"_w{v}", "_rank": f"_r{v}", "total": f"_t{v}"})
        pairs = pairs.join(ranks, _same(by, v) & (F.col(f"_v{v}") == F.col(f"_w{v}"))).drop(f"_w{v}", *[f"_{v}{k}" for k in range(len(by))])
    dx, dy = (F.col(f"_r{v}") - (F.col(f"_t{v}") + 1) / 2.0 for v in ("x", "y"))
    total = lambda c: F.sum(F.col("m") * c)
    corr = total(dx * dy) / F.nullif(F.sqrt(total(dx * dx) * total(dy * dy)), F.lit(0.0))
    return pairs.groupBy(*by).agg(corr.alias("rank_corr"), F.sum("m").alias("n"))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve of each group: the share of pairs of a positive and a negative row that the score puts in order, ties half.

    Rows are counted by score first; the average ranks of the positive ones say it all. Null without both kinds.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = staged(known.groupBy(*by, F.col(score).alias("_x")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("_pos")), "counts")
    ranks = counted_positions(counts, by)
    pos, neg = F.sum("_pos"), F.max("total") - F.sum("_pos")
    area = (F.sum(F.col("_pos") * (F.col("before") + (F.col("n") + 1) / 2.0)) - pos * (pos + 1) / 2.0) / F.nullif((pos * neg).cast("double"), F.lit(0.0))
    return ranks.groupBy(*by).agg(area.alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def interpolated(df: DataFrame, value: str, by: list[str], position: str) -> DataFrame:
    """Gaps filled linearly by position within a group, edges carried."""
    past = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(position))
    v0, v1 = F.last(value, ignorenulls=True).over(past), F.first(value, ignorenulls=True).over(ahead)
    p0, p1 = F.last(at, ignorenulls=True).over(past), F.first(at, ignorenulls=True).over(ahead)
    line = v0 + (v1 - v0) * (F.col(position) - p0) / F.nullif((p1 - p0).cast("double"), F.lit(0.0))
    return df.withColumn(f"{value}_filled", F.coalesce(value, line, v0, v1))


def deviation(value: str, by: list[str]) -> Column:
    """E8."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(*by))


def with_recency(df: DataFrame, day: str, half_life: float) -> DataFrame:
    """Weight that halves every half_life days before the last day; that one is a one-row aggregate, broadcast."""
    last = df.agg(F.max(day).alias("_last_day"))
    age = F.date_diff(F.col("_last_day"), F.col(day))
    return df.crossJoin(F.broadcast(last)).withColumn("weight", F.pow(F.lit(0.5), age / half_life)).drop("_last_day")


def _grouped(df: DataFrame, by: list[str], aggregates: list[Column], value: str, quantiles) -> DataFrame:
    """Aggregates of each group beside exact quantiles q0, q1, ... of a value."""
    out = df.groupBy(*by).agg(*aggregates)
    q = exact_quantiles(df, value, by, quantiles)
    q = q.select(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], *[c for c in q.columns if c not in by])
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)], F.lit(True))
    return out.join(q, same, "left").drop(*[f"_g{k}" for k in range(len(by))])


def moments(df: DataFrame, value: str, by: list[str], quantiles=(0.05, 0.25, 0.5, 0.75, 0.95), tail: float | None = None) -> DataFrame:
    """Mean, bias-corrected skewness and excess kurtosis, exact quantiles, mean less median, share below 0 and above `tail`."""
    above = F.avg((F.col(value) > (tail if tail is not None else float("inf"))).cast("double")).alias("share_tail")
    own = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"), F.avg((F.col(value) < 0).cast("double")).alias("share_negative"), above]
    qs = [*quantiles, 0.5]
    out = _grouped(df, by, own, value, qs)
    n = F.col("n").cast("double")
    skew = F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    kurt = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6)
    out = out.withColumns({"skew": skew, "kurt": kurt, "mean_less_median": F.col("mean") - F.col(f"q{len(quantiles)}")}).drop("_g1", "_g2", f"q{len(quantiles)}")
    return out.withColumnsRenamed({f"q{k}": f"_q{k}" for k in range(len(quantiles))}).withColumnsRenamed({f"_q{k}": f"q{round(q * 100):02d}" for k, q in enumerate(quantiles)})


def regression_by(df: DataFrame, y: str, x: str, by: list[str], at: float, share: str | None = None) -> DataFrame:
    """Slope, intercept, fitted value at x = at, rank correlation and, where named, the mean of a share, per group."""
    extra = [F.avg(share).alias(f"{share}_mean")] if share else []
    out = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"), *extra)
    return out.withColumn("fitted", F.col("intercept") + F.col("slope") * at).join(spearman(df, x, y, by).drop("n"), by, "left")


def group_quantiles(df: DataFrame, value: str, by: list[str], quantiles: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    out = exact_quantiles(df, value, by, quantiles)
    return out.select(*by, *[F.col(f"q{k}").alias(f"p{round(q * 100):02d}") for k, q in enumerate(quantiles)])


def group_and_overall_quantiles(df: DataFrame, value: str, by: list[str], quantiles: list[float]) -> tuple[DataFrame, DataFrame]:
    """group_quantiles of each group, and of all rows, from one count of df; both staged."""
    counts = _counts(df.withColumn("_y", F.col(value).cast("double")), "_y", by)
    whole = staged(counts.groupBy("_x").agg(F.sum("n").alias("n")), "counts")
    out = []
    for c, keys in ((counts, by), (whole, [])):
        q = counted_positions(c, keys, quantiles).groupBy(*keys).agg(*quantile_columns(quantiles))
        out.append(staged(q.select(*keys, *[F.col(f"q{k}").alias(f"p{round(q * 100):02d}") for k, q in enumerate(quantiles)]), "quantiles"))
    return out[0], out[1]


def beside(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """df left-joined to a staged table with each key once. The table is counted: a small one is broadcast, so that df is not shuffled by few keys."""
    return df.join(F.broadcast(table) if table.count() <= FEW else table, on, "left")


def dealt(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """df in partitions by keys of about DEALT rows each, however many rows there are: aggregations and joins by these keys need no other exchange and as much memory as that."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT)), *keys)


def lag_persistence(df: DataFrame, target: str, lags: list[str]) -> DataFrame:
    """Per lag feature the known share, rank correlation and mean absolute difference."""
    long = df.select(target, F.explode(F.create_map(*[x for c in lags for x in (F.lit(c), F.col(c))])).alias("feature", "value"))
    stats = long.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("known_share"), F.avg(F.abs(F.col(target) - F.col("value"))).alias("mae"))
    return stats.join(spearman(long, target, "value", ["feature"]).select("feature", "rank_corr"), "feature", "left")


def binned(df: DataFrame, value: str, x: str, edges: list[float]) -> DataFrame:
    """Count, median, P90 - P10 and share below 0 of value by left-closed bins of x."""
    bin_ = reduce(lambda acc, k: F.when((F.col(x) >= edges[k]) & (F.col(x) < edges[k + 1]), F.lit(k)).otherwise(acc), range(len(edges) - 1), F.lit(None).cast("int"))
    rows = df.withColumn("bin", bin_).filter("bin is not null")
    out = _grouped(rows, ["bin"], [F.count(value).alias("n"), F.avg((F.col(value) < 0).cast("double")).alias("share_negative")], value, [0.1, 0.5, 0.9])
    return out.select("bin", "n", F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("spread"), "share_negative")


def autocorrelation(daily: DataFrame, value: str, day: str, lags: list[int]) -> DataFrame:
    """Correlation of a daily series with itself some days earlier, joined by date, all lags in one pass."""
    past = daily.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), F.col(day).alias("_from"), F.col(value).alias("_past"))
    past = past.select("lag", F.date_add("_from", F.col("lag")).alias(day), "_past")
    return daily.join(past, day).groupBy("lag").agg(F.corr(value, "_past").alias("corr"))


def shape_correlation(df: DataFrame, value: str, day: str, period: str, lag: int, least: int = 40) -> DataFrame:
    """One row: lag, days compared and the median over days of the correlation of a day's deviations with those `lag` days before.

    A day takes part if more than `least` of its periods and of the earlier day's are known.
    """
    dev = df.groupBy(day, period).agg(F.avg(value).alias("_v")).withColumn("_v", deviation("_v", [day])).filter("_v is not null")
    dev = dev.withColumn("_known", F.count("*").over(Window.partitionBy(day))).filter(F.col("_known") > least)
    past = dev.select(F.date_add(day, lag).alias(day), period, F.col("_v").alias("_p"))
    per = dev.join(past, [day, period]).groupBy(day).agg(F.corr("_v", "_p").alias("_c")).filter("_c is not null")
    return exact_quantiles(per, "_c", [], [0.5]).select(F.lit(lag).alias("lag"), F.col("q0").alias("median_corr")).join(per.agg(F.count("*").alias("days")))


def levels_by_month(df: DataFrame, value: str, day: str) -> DataFrame:
    """Mean and sample deviation by month."""
    return df.groupBy(F.trunc(day, "month").alias("month")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def profile(df: DataFrame, value: str, flag: Column, hour: Column) -> DataFrame:
    """Mean by flag and hour."""
    return df.groupBy(flag.alias("flag"), hour.alias("hour")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def profile_premiums(shape: DataFrame, peak: tuple[int, int]) -> DataFrame:
    """One row from a profile: mean of the peak hours (both included) over the mean of all hours without the flag, and of flagged hours under it."""
    plain, marked = F.when(~F.col("flag"), F.col("mean")), F.when(F.col("flag"), F.col("mean"))
    top = F.when(~F.col("flag") & F.col("hour").between(*peak), F.col("mean"))
    return shape.agg((F.avg(top) - F.avg(plain)).alias("peak_premium"), (F.avg(marked) - F.avg(plain)).alias("flag_discount"))


def errors_by_group(df: DataFrame, y: str, low: str, mid: str, high: str, group: Column, order: list[str]) -> DataFrame:
    """Coverage, shares below and above, and mean absolute error per named group, in the order of the names."""
    known = df.filter(F.col(y).isNotNull()).withColumn("group", group)
    share = lambda c: F.avg(c.cast("double"))
    out = known.groupBy("group").agg(
        F.count("*").alias("n"),
        share(F.col(y).between(F.col(low), F.col(high))).alias("coverage"),
        share(F.col(y) < F.col(low)).alias("below"),
        share(F.col(y) > F.col(high)).alias("above"),
        F.avg(F.abs(F.col(y) - F.col(mid))).alias("mae"),
    )
    return in_order(out, "group", order)


def in_order(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows in the order of given names, others last."""
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(names) + 1), column)


def first_and_last(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group the columns of its first and its last row in order, as first_<name> and last_<name>."""
    key, whole = F.struct(*order), F.struct(*columns)
    out = df.groupBy(*by).agg(F.min_by(whole, key).alias("_a"), F.max_by(whole, key).alias("_z"))
    return out.select(*by, *[F.col(f"_a.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"_z.{c}").alias(f"last_{c}") for c in columns])


def best_of(df: DataFrame, by: list[str], score: str, columns: list[str], tie: list[str]) -> DataFrame:
    """per group the row with the highest and that with the lowest score (of equals the first by `tie`): top_<name>, low_<name>."""
    whole = F.struct(*columns)
    low = F.min_by(whole, F.struct(score, *tie))
    top = F.min_by(whole, F.struct((-F.col(score)).alias("_s"), *tie))
    out = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(top.alias("_t"), low.alias("_l"))
    return out.select(*by, *[F.col(f"_t.{c}").alias(f"top_{c}") for c in columns], *[F.col(f"_l.{c}").alias(f"low_{c}") for c in columns])


def missingness(df: DataFrame, columns: list[str], above: float = 0.001) -> DataFrame:
    """Columns whose share of nulls is above a limit."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_share").filter(F.col("null_share") > above)


def drift(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Means of features in the earlier (flag false) and later period."""
    one = df.groupBy().agg(*[F.avg(F.when(F.col(flag) == later, F.col(c))).alias(f"{c}|{int(later)}") for c in columns for later in (False, True)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|0`").alias("earlier"), F.col(f"`{c}|1`").alias("later")) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column the rows that differ (null equals null, doubles within a relative tolerance) or are on one side only."""
    x, y = a.withColumn("_in", F.lit(True)).alias("x"), b.withColumn("_in", F.lit(True)).alias("y")
    cond = reduce(Column.__and__, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    kinds = dict(a.dtypes)
    one_side = F.col("x._in").isNull() | F.col("y._in").isNull()

    def differs(c):
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        if kinds[c] not in ("double", "float"):
            return one_side | ~p.eqNullSafe(q)
        near = F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q))
        return one_side | ~(p.eqNullSafe(q) | F.coalesce(near, F.lit(False)))

    one = x.join(y, cond, "full_outer").agg(*[F.count_if(differs(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "mismatches")


def key_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on the left only, on the right only, and columns (sorted, comma) on one side only."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    names = ",".join(sorted(set(a.columns) ^ set(b.columns)))
    count = lambda p, q, n: p.exceptAll(q).agg(F.count("*").alias(n))
    return count(left, right, "left_only").join(count(right, left, "right_only")).withColumn("columns_differ", F.lit(names))


def beyond_common_range(tables: dict[str, DataFrame], day: str) -> DataFrame:
    """Per table the rows after the last day that all tables reach."""
    parts = [df.select(F.lit(name).alias("table_name"), F.col(day).alias("_d")) for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    last = rows.groupBy("table_name").agg(F.max("_d").alias("_m")).agg(F.min("_m").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).groupBy("table_name").agg(F.count_if(F.col("_d") > F.col("_last")).alias("beyond"), F.max("_last").alias("common_end"))


def complete_until(df: DataFrame, day: str, target: str, share: float = 0.9) -> DataFrame:
    """Rows up to the last day whose targets are known for `share` of its rows."""
    last = df.groupBy(day).agg(F.avg(F.col(target).isNotNull().cast("double")).alias("s")).filter(F.col("s") >= share).agg(F.max(day).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(day) <= F.col("_last")).drop("_last")
