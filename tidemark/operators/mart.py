"""Assembly of a feature mart: filters, derived columns and joins of feature groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import to_local


def renamed(df: DataFrame, columns: dict[str, tuple[str, str]], where: dict[str, object] | None = None) -> DataFrame:
    """Columns under new names and types, of rows where columns equal constants; new name -> (old name, type)."""
    for column, value in (where or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    return df.select(*[F.col(old).cast(kind).alias(new) for new, (old, kind) in columns.items()])


def known_if(value: str, condition: Column) -> Column:
    """B2: value where the condition holds, else null."""
    return F.when(condition, F.col(value))


def known(df: DataFrame, column: str) -> DataFrame:
    """Rows that have a value."""
    return df.filter(F.col(column).isNotNull())


def passed(df: DataFrame, now: Column, cutoff: str = "cutoff_utc") -> DataFrame:
    """Rows whose cutoff is not after now."""
    return df.filter(F.col(cutoff) <= now)


def issued_between(df: DataFrame, issued: str, low: str, high: str, zone: str | None = None) -> DataFrame:
    """Vintages whose time of day is in [low, high), both HH:mm:ss, on the clock of a zone or UTC."""
    clock = F.date_format(to_local(issued, zone) if zone else F.col(issued), "HH:mm:ss")
    return df.filter((clock >= low) & (clock < high))


def flagged(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Boolean columns that tell whether others have a value; flag -> column."""
    return df.withColumns({flag: F.col(c).isNotNull() for flag, c in flags.items()})


def safe_ratio(a: str, b: str) -> Column:
    """A / b, null where b is 0."""
    return F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))


def relative(df: DataFrame, columns: list[str], level: str, suffix: str = "_rel") -> DataFrame:
    """Columns less a level beside them, and booleans as doubles."""
    out = df.withColumns({f"{c}{suffix}": F.col(c) - F.col(level) for c in columns})
    return out.withColumns({c: F.col(c).cast("int").cast("double") for c, kind in df.dtypes if kind == "boolean"})


def feature_list(base: list[str], add: list[str] = (), drop: list[str] = ()) -> list[str]:
    """Names of base and add in order, without repeats and without those to drop; dropping what isn't there is an error."""
    names = list(dict.fromkeys([*base, *add]))
    unknown = set(drop) - set(names)
    if unknown:
        raise ValueError(f"no such features: {sorted(unknown)}")
    return [n for n in names if n not in set(drop)]


def supply_share(supply: list[str], demand: list[str]) -> Column:
    """Sum of supply columns over that of demand columns; null if any is, or the demand is 0."""
    total = lambda names: reduce(Column.__add__, [F.col(n).cast("double") for n in names])
    return total(supply) / F.nullif(total(demand), F.lit(0.0))


def before_holdout(df: DataFrame, day: str, last_months: int) -> DataFrame:
    """Rows before the first of the last months of the table."""
    last = df.agg(F.add_months(F.trunc(F.max(day), "month"), 1 - last_months).alias("_cut"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(day) < F.col("_cut")).drop("_cut")


def whole_months(day: str, every: int = 3) -> Column:
    """True in months whose number is a multiple of `every`: held out whole."""
    return F.month(day) % every == 0


def star(spine: DataFrame, groups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Spine left-joined to feature groups, each on its keys; names that clash are an error."""
    for df, on in groups:
        clash = (set(df.columns) - set(on)) & set(spine.columns)
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        spine = spine.join(df, on, "left")
    return spine


def back_to_grain(spine: DataFrame, coarse: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    """Aggregates of a coarser grain beside every row of the spine; counts are 0 where there is none."""
    out = spine.join(coarse, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def swapped(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Columns taken from another table with the same keys, as they were where that has no value."""
    new = other.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(new, on, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    return out.select(*df.columns)


def with_aggregate(df: DataFrame, other: DataFrame, on: list[str], aggregates: list[Column]) -> DataFrame:
    """C20: rows joined to aggregates of another table by the same keys."""
    return df.join(other.groupBy(*on).agg(*aggregates), on)


def observed(spine: DataFrame, series: DataFrame, on: list[str], aggregates: list[Column], keys: list[str]) -> DataFrame:
    """Aggregates of what was observed per spine row, whatever the cutoff: an experiment's control, not a feature."""
    return spine.join(series, on).groupBy(*keys).agg(*aggregates)


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of tables that must have the same keys, each once (null keys count); anything else is an error."""
    n = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    same = lambda x, y: reduce(Column.__and__, [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in on])
    both = n(a, "_na").alias("a").join(n(b, "_nb").alias("b"), same("a", "b"), "full_outer")
    bad = both.filter(~(F.col("_na").eqNullSafe(F.lit(1)) & F.col("_nb").eqNullSafe(F.lit(1))))
    if not bad.isEmpty():
        raise ValueError(f"not one to one on {on}")
    right = b.select(*[F.col(c) for c in b.columns])
    joined = a.alias("a").join(right.alias("b"), same("a", "b"))
    return joined.select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in on])


def wide_with_actual(long: DataFrame, keys: list[str], model: str, models: list[str], value: str, actual: str) -> DataFrame:
    """One column per model, and the actual value of the key (of repeated ones the largest known), in one aggregation."""
    return long.groupBy(*keys).agg(*[F.avg(F.when(F.col(model) == name, F.col(value))).alias(name) for name in models], F.max(actual).alias(actual))


def looked_up(df: DataFrame, table: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    """Value of a keyed table beside each row; the table must have each key once."""
    return df.join(table.select(*on, F.col(value).alias(name)), on, "left")


def settled(forecasts: DataFrame, actuals: DataFrame, on: list[str]) -> DataFrame:
    """Forecasts whose actual is known, with it."""
    return forecasts.join(actuals, on)


def with_dimension(df: DataFrame, dimension: DataFrame, on: dict[str, str], columns: dict[str, object]) -> DataFrame:
    """Columns of a dimension beside each row, a default where it has no such key or no value; on maps keys of df to those of the dimension, columns to defaults."""
    side = dimension.select(*[F.col(k).alias(f"_d{n}") for n, k in enumerate(on.values())], *columns).dropDuplicates([f"_d{n}" for n in range(len(on))])
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_d{n}") for n, k in enumerate(on)])
    out = df.join(side, same, "left").drop(*[f"_d{n}" for n in range(len(on))])
    return out.withColumns({c: F.coalesce(c, F.lit(default)) for c, default in columns.items()})


def with_weights(df: DataFrame, weights: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Rows that have a weight, with it."""
    return df.join(weights.select(*on, F.col(weight).cast("double").alias(weight)), on)


def first_known(*columns) -> Column:
    """The first of the columns (or numbers, as a last resort) that has a value."""
    return F.coalesce(*[F.lit(c) if isinstance(c, int | float) else c for c in columns])
