"""Walk-forward folds from prefix sums over days (J1, J10 to J12): history is read once, whatever the number of folds.

Sums that can be added are taken per day and summed up from the first day on.
What a fold trains on is the difference of two such prefixes, found by equality
on the day. A linear model needs no more than sums: the Gram matrix of its
features; all folds are solved from their prefixes in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_prefixes(df: DataFrame, day: str, sums: dict[str, Column]) -> DataFrame:
    """_day and each of sums over all rows up to that day, for every day from that before the first to the last; doubles, nulls count as 0.

    The sums of a day are taken on all tasks; what is then ordered in one is a row per day.
    """
    daily = df.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("_day")).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n) for n, c in sums.items()])
    span = daily.agg(F.min("_day").alias("a"), F.max("_day").alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence(F.date_sub("a", 1), F.col("b"))).alias("_day"))
    so_far = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(daily, "_day", "left").select("_day", *[F.coalesce(F.sum(n).over(so_far), F.lit(0.0)).alias(n) for n in sums])


def _at(folds: DataFrame, prefixes: DataFrame, when: Column, names: list[str], prefix: str) -> DataFrame:
    """folds with the sums up to a day, which is the first or last of the table where it is outside."""
    ends = F.broadcast(prefixes.agg(F.min("_day").alias("_first"), F.max("_day").alias("_last")))
    rows = folds.crossJoin(ends).withColumn("_day", F.least(F.greatest(when, F.col("_first")), F.col("_last")))
    found = prefixes.select("_day", *[F.col(n).alias(f"{prefix}{n}") for n in names])
    return rows.join(found, "_day", "left").drop("_day", "_first", "_last")


def fold_sums(folds: DataFrame, prefixes: DataFrame, names: list[str], last_days: int | None = None) -> DataFrame:
    """Folds (fold, test_start, test_end, train_end) with train_<name> and test_<name>; training is all before, or the last days only."""
    out = _at(folds, prefixes, F.col("train_end"), names, "_b_")
    out = _at(out, prefixes, F.date_sub("train_end", last_days), names, "_a_") if last_days is not None else out.withColumns({f"_a_{n}": F.lit(0.0) for n in names})
    out = _at(_at(out, prefixes, F.col("test_end"), names, "_d_"), prefixes, F.date_sub("test_start", 1), names, "_c_")
    return out.select(*folds.columns, *[(F.col(f"_b_{n}") - F.col(f"_a_{n}")).alias(f"train_{n}") for n in names], *[(F.col(f"_d_{n}") - F.col(f"_c_{n}")).alias(f"test_{n}") for n in names])


def _gram(features: list[str], y: str, weight: Column) -> dict[str, Column]:
    """Entries of the upper half of the weighted Gram matrix of (1, features, y); rows with a gap are left out."""
    some = F.array_contains(F.array(*[F.col(c).isNotNull() for c in (*features, y)]), False)
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, y)]]
    return {f"g{i}_{j}": F.when(~some, weight * columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))}


def linear_folds(df: DataFrame, folds: DataFrame, features: list[str], y: str, day: str, half_life: float | None = None, last_days: int | None = None, ridge: float = 0.0) -> DataFrame:
    """A row per fold: fold, n (weighted rows), intercept, beta (one per feature) of the least-squares line through its training rows.

    With a half-life a row's weight halves with that many days before the fold's
    last training day. Such weights differ between folds by a factor only, so
    one set of sums does for all; they are taken against the last day of the
    table, which is fine for spans of up to a thousand half-lives. Features are
    centred on their training mean; ridge is added to the centred squares.
    Coefficients that the training rows don't determine come from the
    pseudo-inverse; a fold without rows has nulls.
    """
    import numpy as np
    import pandas as pd

    p = len(features)
    # sums of squares about a value near the mean: less is lost when the mean's square is taken off
    shift = df.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate((*features, y))]).first()
    rows = df.select(day, *[(F.col(c).cast("double") - F.lit(shift[k])).alias(f"_c{k}") for k, c in enumerate((*features, y))])
    if half_life is None:
        weight = F.lit(1.0)
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max(day).alias("_top"))))
        weight = F.pow(F.lit(0.5), F.date_diff("_top", day) / half_life)
    entries = _gram([f"_c{k}" for k in range(p)], f"_c{p}", weight)
    sums = fold_sums(folds, day_prefixes(rows, day, entries), list(entries), last_days)
    means = [float(x) for x in shift]

    def solved(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                g = np.zeros((p + 2, p + 2))
                for i in range(p + 2):
                    for j in range(i, p + 2):
                        g[i, j] = g[j, i] = getattr(r, f"train_g{i}_{j}")
                n = g[0, 0]
                if not n > 0:
                    out.append((r.fold, 0.0, None, None))
                    continue
                mean = g[0, 1:] / n
                s = g[1:, 1:] - n * np.outer(mean, mean)
                beta = np.linalg.pinv(s[:p, :p] + ridge * np.eye(p), rcond=1e-12, hermitian=True) @ s[:p, p]
                at = mean + np.array(means)
                out.append((r.fold, n, float(at[p] - beta @ at[:p]), beta.tolist()))
            yield pd.DataFrame(out, columns=["fold", "n", "intercept", "beta"])

    return sums.mapInPandas(solved, "fold string, n double, intercept double, beta array<double>")


def predicted(test: DataFrame, models: DataFrame, features: list[str], name: str = "point") -> DataFrame:
    """Rows of test (with their fold) and the value that their fold's model gives them; null where a feature is."""
    line = F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), F.col("beta"), lambda x, b: x * b), F.col("intercept"), lambda s, v: s + v)
    return test.join(models.select("fold", "intercept", "beta"), "fold", "left").withColumn(name, line).drop("intercept", "beta")


def tested(df: DataFrame, folds: DataFrame, day: str) -> DataFrame:
    """Rows in the test month of a fold, with the fold; folds are months, so this is a lookup and not a range join."""
    month = F.trunc(day, "month")
    of = folds.select("fold", F.trunc("test_start", "month").alias("_month"), "test_start", "test_end")
    rows = df.withColumn("_month", month).join(of, "_month")
    return rows.filter(F.col(day).between(F.col("test_start"), F.col("test_end"))).drop("_month", "test_start", "test_end")
