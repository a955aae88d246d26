"""Walk-forward folds, naive forecasts, conformal calibration and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.metrics import mean_pinball, metric_columns
from tidemark.functions.timeutil import quantile_name, sorted_row
from tidemark.operators.series import auc, counted_positions, exact_quantiles, quantile_columns
from tidemark.sources.staging import staged


def monthly_folds(spark: SparkSession, first: str, last: str, gap_days: int = 2) -> DataFrame:
    """Fold, test_start, test_end, train_end per month; the last month may be partial."""
    m = spark.sql(f"SELECT explode(sequence(trunc(DATE'{first}','MM'), DATE'{last}', INTERVAL 1 MONTH)) AS test_start")
    return m.select(F.date_format("test_start", "yyyy-MM").alias("fold"), "test_start", F.least(F.last_day("test_start"), F.lit(last).cast("date")).alias("test_end"), F.date_sub("test_start", gap_days).alias("train_end"))


def fold_rows(df: DataFrame, folds: DataFrame, day: str, last_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of every fold at once, for what can't be added up: history is repeated for each fold (see operators.folds for sums).

    last_days limits training to a rolling window.
    """
    lower = F.lit(True) if last_days is None else F.col(day) > F.date_sub("train_end", last_days)
    train = df.join(folds, (F.col(day) <= F.col("train_end")) & lower)
    test = df.join(folds, F.col(day).between(F.col("test_start"), F.col("test_end")))
    return train, test


def leaking_folds(train: DataFrame, test: DataFrame, start: str, cutoff: str) -> DataFrame:
    """Folds where a training period ends after the first test cutoff."""
    a = train.groupBy("fold").agg((F.max(start) + F.expr("INTERVAL 30 MINUTE")).alias("train_until"))
    b = test.groupBy("fold").agg(F.min(cutoff).alias("first_cutoff"))
    return a.join(b, "fold").filter("train_until > first_cutoff")


def naive_fit(train: DataFrame, y: str, point: Column, group: str, quantiles: list[float], keys: list[str], middle_zero: bool = True) -> DataFrame:
    """Residual quantiles per group; the middle one is 0."""
    rows = train.withColumn("_r", F.col(y) - point).filter("_r is not null")
    out = exact_quantiles(rows, "_r", [*keys, group], quantiles)
    return out.select(*keys, group, *[(F.lit(0.0) if middle_zero and q == 0.5 else F.col(f"q{k}")).alias(f"off_{quantile_name(q)}") for k, q in enumerate(quantiles)])


def naive_predict(test: DataFrame, offsets: DataFrame, point: Column, group: str, quantiles: list[float], keys: list[str]) -> DataFrame:
    """Point plus offset (0 where a group is unknown), quantiles in order."""
    names = [quantile_name(q) for q in quantiles]
    out = test.join(offsets, [*keys, group], "left")
    out = out.withColumns({n: point + F.coalesce(f"off_{n}", F.lit(0.0)) for n in names}).drop(*[f"off_{n}" for n in names])
    return out.withColumns(sorted_row(names))


def conformal_shifts(calibration: DataFrame, y: str, quantiles: list[float], keys: list[str], mode: str = "all") -> DataFrame:
    """Per key the quantile of y - raw quantile over calibration rows; mode none, outer (not the middle) or all.

    Equal rows are counted first and staged as one: what follows grows with different ones.
    """
    names = [quantile_name(q) for q in quantiles]
    calibration = staged(calibration.groupBy(*keys, y, *names).agg(F.count("*").alias("_rows")), "calibration")
    out = calibration.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(y).isNotNull(), F.col("_rows"))), F.lit(0)).alias("n_calibration"))
    # all quantiles in one pass: a row's gap to each is one row
    gaps = F.array(*[F.struct(F.lit(float(q)).alias("_q"), (F.col(y) - F.col(quantile_name(q))).alias("_gap")) for q in quantiles])
    long = calibration.select(*keys, "_rows", F.inline(gaps)).filter("_gap is not null")
    counts = staged(long.groupBy(*keys, "_q", F.col("_gap").alias("_x")).agg(F.sum("_rows").alias("n")), "counts")
    each = counted_positions(counts, [*keys, "_q"], [F.col("_q")]).groupBy(*keys, "_q").agg(quantile_columns([F.col("_q")])[0].alias("_shift"))
    fixed = lambda q: mode == "none" or (mode == "outer" and q == 0.5)
    wide = each.groupBy(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)]).agg(*[F.max(F.when(F.col("_q") == float(q), F.lit(0.0) if fixed(q) else F.col("_shift"))).alias(f"shift_{quantile_name(q)}") for q in quantiles])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)], F.lit(True))
    return out.join(wide, same, "left").drop(*[f"_k{k}" for k in range(len(keys))]) if keys else out.crossJoin(F.broadcast(wide))


def calibration_split(df: DataFrame, day: str, days: int = 56, gap_days: int = 2) -> tuple[DataFrame, DataFrame]:
    """(fit, calibration): the last days are held out for calibration, and a gap before them is left out."""
    rows = df.crossJoin(F.broadcast(df.agg(F.max(day).alias("_last"))))
    start = F.date_sub("_last", days - 1)
    return rows.filter(F.col(day) < F.date_sub(start, gap_days)).drop("_last"), rows.filter(F.col(day) >= start).drop("_last")


def shifted(df: DataFrame, shifts: DataFrame, quantiles: list[float], keys: list[str], group: str | None = None, by_group: DataFrame | None = None) -> DataFrame:
    """Quantiles plus shifts of the group, or of all where the group has none, in order."""
    names = [quantile_name(q) for q in quantiles]
    out = df.join(shifts.drop("n_calibration"), keys, "left")
    if by_group is not None:
        own = by_group.select(*keys, group, *[F.col(f"shift_{n}").alias(f"own_{n}") for n in names])
        out = out.join(own, [*keys, group], "left")
    move = lambda n: F.coalesce(*([F.col(f"own_{n}")] if by_group is not None else []), F.col(f"shift_{n}"), F.lit(0.0))
    out = out.withColumns({n: F.col(n) + move(n) for n in names})
    return out.drop(*[f"shift_{n}" for n in names], *[f"own_{n}" for n in names]).withColumns(sorted_row(names))


def verdict(gain: DataFrame, low: Column, coverage: Column, least_folds: int = 9, within: tuple[float, float] = (0.77, 0.83)) -> DataFrame:
    """Whether an experiment is adopted."""
    return gain.withColumn("adopted", (low > 0) & (F.col("folds_won") >= least_folds) & coverage.between(*within))


def promotion(df: DataFrame, y: str, quantiles: list[float], least_rows: int) -> DataFrame:
    """One row: losses of champion and challenger on rows both predict, and whether to promote (strictly lower, on least_rows or more)."""
    wide = df.withColumn("_l", mean_pinball(y, quantiles)).groupBy("row_id").agg(F.avg(F.when(F.col("model") == "champion", F.col("_l"))).alias("a"), F.avg(F.when(F.col("model") == "challenger", F.col("_l"))).alias("b"))
    one = wide.filter("a is not null and b is not null").agg(F.count("*").alias("n"), F.avg("a").alias("champion"), F.avg("b").alias("challenger"))
    return one.withColumn("promote", (F.col("n") >= least_rows) & (F.col("challenger") < F.col("champion")))


def judgement_rows(df: DataFrame, trained_until: dict[str, str], day: str, gap_days: int = 2) -> DataFrame:
    """Rows that neither model has seen: after the later end of training and a gap."""
    after = F.date_add(F.greatest(*[F.lit(d).cast("date") for d in trained_until.values()]), gap_days)
    return df.filter(F.col(day) > after)


def delevelled(df: DataFrame, y: str, level: str, name: str = "y_rel") -> DataFrame:
    """Target less its trailing level; null where either is."""
    return df.withColumn(name, F.col(y) - F.col(level))


def relevelled(df: DataFrame, columns: list[str], level: str) -> DataFrame:
    """The level added back to predictions of a de-levelled target."""
    return df.withColumns({c: F.col(c) + F.col(level) for c in columns})


def fold_metrics(df: DataFrame, fold: str = "fold", model: str = "model", y: str = "y", quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """Metrics by fold and model."""
    return df.groupBy(fold, model).agg(*metric_columns(y, quantiles))


def leakage_cost(variants: dict[str, DataFrame], honest: str, y: str = "y", quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """Metrics of predictions from each variant of the features, and how much better than the honest one each looks."""
    parts = [df.select(F.lit(name).alias("features"), y, *[quantile_name(q) for q in quantiles]) for name, df in variants.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = rows.groupBy("features").agg(*metric_columns(y, quantiles))
    base = F.max(F.when(F.col("features") == honest, F.col("pinball"))).over(Window.partitionBy())
    return out.withColumn("flattery", 1 - F.col("pinball") / F.nullif(base, F.lit(0.0)))


def latest_fold(df: DataFrame, day: str, y: str, days: int, gap_days: int = 2) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last days with known targets are the test."""
    known = df.filter(F.col(y).isNotNull())
    last = F.broadcast(df.filter(F.col(y).isNotNull()).agg(F.max(day).alias("_last")))
    rows = known.crossJoin(last)
    start = F.date_sub("_last", days - 1)
    return rows.filter(F.col(day) <= F.date_sub(start, gap_days)).drop("_last"), rows.filter(F.col(day) >= start).drop("_last")


def point_model(train: DataFrame, features: list[str], y: str, kind: str = "gbt", weight: str | None = None, missing_above: float = 0.01, **params):
    """Spark ML pipeline: median imputation (0 for a feature that is null throughout), indicators and a regressor.

    Features of which more than missing_above is null get an indicator; all
    features must be numeric. `weight` names a column of row weights.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = train.filter(F.col(y).isNotNull())
    share = rows.agg(*[F.coalesce(F.avg(F.col(f).isNull().cast("double")), F.lit(1.0)).alias(f) for f in features]).first()
    empty, some = [f for f in features if share[f] == 1], [f for f in features if share[f] < 1]
    flagged = [f for f in some if share[f] > missing_above]
    shown = [f"CAST(`{f}` IS NULL AS DOUBLE) AS `{f}_missing`" for f in flagged] + [f"CAST(0 AS DOUBLE) AS `{f}_filled`" for f in empty] + [f"CAST(`{f}` AS DOUBLE) AS `{f}_known`" for f in some]
    flags = SQLTransformer(statement="SELECT *, " + ", ".join(shown) + " FROM __THIS__")
    fill = [Imputer(strategy="median", inputCols=[f"{f}_known" for f in some], outputCols=[f"{f}_filled" for f in some])] if some else []
    pack = VectorAssembler(inputCols=[f"{f}_filled" for f in features] + [f"{f}_missing" for f in flagged], outputCol="_x")
    extra = {"weightCol": weight} if weight else {}
    if kind == "linear":
        stages = [flags, *fill, pack, StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LinearRegression(featuresCol="_z", labelCol=y, predictionCol="point", **extra, **params)]
    else:
        stages = [flags, *fill, pack, GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="point", **extra, **params)]
    return Pipeline(stages=stages).fit(rows)


def linear_design(train: DataFrame, rows: DataFrame, features: list[str], missing_above: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Rows with features ready for a linear model, and their names, all learned from train.

    A missing value becomes the exact median of train (0 if it has none); a
    feature of which more than missing_above is missing there also gets an
    indicator <f>_missing; then <f>_z is the value less its mean over its sample
    deviation (both with medians filled in, a deviation of 0 counts as 1). Train
    is read twice: for medians, all in one pass, and for means and deviations.
    """
    long = train.select(F.inline(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("_v")) for f in features])))
    middle = {r._f: r.q0 for r in exact_quantiles(long, "_v", ["_f"], [0.5]).collect()}
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(middle.get(f, 0.0)))) for f in features}
    s = train.agg(*[c.alias(f"{kind}{k}") for k, f in enumerate(features) for kind, c in (("a", F.avg(filled[f])), ("d", F.stddev_samp(filled[f])), ("n", F.avg(F.col(f).isNull().cast("double"))))]).first()
    flagged = [f for k, f in enumerate(features) if (s[f"n{k}"] or 0.0) > missing_above]
    shown = {f"{f}_z": (filled[f] - F.lit(s[f"a{k}"] or 0.0)) / F.lit(s[f"d{k}"] or 1.0) for k, f in enumerate(features)}
    shown |= {f"{f}_missing": F.col(f).isNull().cast("double") for f in flagged}
    return rows.withColumns(shown), list(shown)


def importance(spark: SparkSession, model) -> DataFrame:
    """(feature, gain_share) of a fitted tree pipeline, largest first; indicators are features of their own."""
    from pyspark.ml.feature import VectorAssembler

    pack = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = [n.removesuffix("_filled") for n in pack.getInputCols()]
    gain = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(g)) for n, g in zip(names, gain, strict=True)]
    return spark.createDataFrame(rows, "feature string, gain_share double").orderBy(F.desc("gain_share"), "feature")


def with_residual_quantiles(model, fit: DataFrame, calibration: DataFrame, y: str, quantiles: list[float]) -> DataFrame:
    """Rows of `fit` with the point forecast and quantiles p10, ...: the point plus quantiles of the residuals of calibration rows."""
    residual = model.transform(calibration).select((F.col(y) - F.col("point")).alias("_r"))
    return _with_offsets(model.transform(fit).drop("_x", "_z"), residual, quantiles)


def _with_offsets(pointed: DataFrame, residual: DataFrame, quantiles: list[float]) -> DataFrame:
    q = exact_quantiles(residual, "_r", [], quantiles)
    out = pointed.crossJoin(F.broadcast(q))
    out = out.withColumns({quantile_name(x): F.col("point") + F.col(f"q{k}") for k, x in enumerate(quantiles)})
    return out.drop(*[f"q{k}" for k in range(len(quantiles))]).withColumns(sorted_row([quantile_name(x) for x in quantiles]))


def residual_forecast(train: DataFrame, test: DataFrame, features: list[str], y: str, day: str, quantiles: list[float], days: int = 56, gap_days: int = 2, half_life: float | None = None) -> DataFrame:
    """J9 in one call: a linear point model of all but the last days of train, and quantiles from its residuals on these days.

    The calibration days are cut off with a gap before them; the model is
    fitted on what is before (with recency weights, if a half-life is given),
    and test rows get its point plus the residuals' quantiles, in order.
    """
    from tidemark.operators.folds import linear_folds, predicted

    fit, calibration = calibration_split(train.filter(F.col(y).isNotNull()), day, days, gap_days)
    last = fit.agg(F.max(day).alias("train_end"))
    one = last.select(F.lit("all").alias("fold"), F.col("train_end").alias("test_start"), F.col("train_end").alias("test_end"), "train_end")
    model = staged(linear_folds(fit, one, features, y, day, half_life), "model")
    point = lambda rows: predicted(rows.withColumn("fold", F.lit("all")), model, features).drop("fold")
    residual = point(calibration).select((F.col(y) - F.col("point")).alias("_r"))
    return _with_offsets(point(test), residual, quantiles)


def block_of_months(day: str, months: int, blocks: int) -> Column:
    """Number of the block of a row when blocks of so many months take turns."""
    return F.floor((F.year(day) * 12 + F.month(day) - 1) / months) % blocks


def cross_fitted(df: DataFrame, features: list[str], label: str, block: str, blocks: int, **params) -> DataFrame:
    """Df with _score, the probability of label that a tree classifier gives each row that was fitted on the other blocks.

    Each row is scored once by a model that hasn't seen its block. Nulls in
    features are taken as 0. One model per block is fitted by Spark ML.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumns({f"_f{k}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in enumerate(features)}).withColumn("_label", F.col(label).cast("double"))
    pack = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="_x")
    out = None
    for b in range(blocks):
        model = Pipeline(stages=[pack, GBTClassifier(featuresCol="_x", labelCol="_label", **{"maxIter": 10, "maxDepth": 4, "seed": 1, **params})]).fit(rows.filter(F.col(block) != b))
        scored = model.transform(rows.filter(F.col(block) == b)).select(*df.columns, vector_to_array("probability")[1].alias("_score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def separability(scored: DataFrame, label: str, by: list[str]) -> DataFrame:
    """How well scores tell the two periods apart: auc, positives, negatives per group (0.5: not at all)."""
    return auc(scored, "_score", label, by)


def adversarial(df: DataFrame, features: list[str], later: Column, test: Column, top: int = 6, above: float = 0.05, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Can two periods be told apart: (auc with all features, without the markers, markers), (feature, gain_share).

    `test` rows (whole months, say) are held out. Markers are the `top` features
    by gain with a share above a limit, without those named in `keep`.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], later.cast("double").alias("_later"), test.alias("_test"))

    def fit(names):
        pack = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep")
        model = Pipeline(stages=[pack, GBTClassifier(featuresCol="_x", labelCol="_later", maxIter=20, maxDepth=4, seed=1)]).fit(rows.filter(~F.col("_test")).na.fill(0.0, names))
        scored = model.transform(rows.filter("_test").na.fill(0.0, names)).select("_later", vector_to_array("probability")[1].alias("_score"))
        return model, auc(scored, "_score", "_later", []).first().auc

    model, whole = fit(features)
    gain = importance(spark, model)
    markers = [r.feature for r in gain.limit(top).collect() if r.gain_share > above and r.feature not in keep]
    rest = [f for f in features if f not in markers]
    without = fit(rest)[1] if rest else 0.5
    return spark.createDataFrame([(whole, without, markers)], "auc double, auc_without_markers double, markers array<string>"), gain


def leaderboard(df: DataFrame, loss: str, baseline: str) -> DataFrame:
    """F8: models by loss with skill against a baseline."""
    base = F.max(F.when(F.col("model") == baseline, F.col(loss))).over(Window.partitionBy())
    return df.withColumn("skill", 1 - F.col(loss) / F.nullif(base, F.lit(0.0))).orderBy(loss, "model")
