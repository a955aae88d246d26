"""Readers and sinks of a chunked Parquet lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.versions import current, publish, write_chunks


def read_lake(spark: SparkSession, root: str, dataset: str, schema: T.StructType) -> DataFrame:
    """A1: <root>/<source>/<name> with a declared schema; `_chunk` comes from the directories."""
    return spark.read.schema(schema).parquet(f"{root}/{dataset}")


def select_datasets(catalogue: list[str], pattern: str) -> list[str]:
    """`source` or `source/name`; unknown patterns are an error."""
    found = [d for d in catalogue if d == pattern or d.split("/")[0] == pattern]
    if not found:
        raise ValueError(f"no dataset matches {pattern}")
    return found


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2."""
    return spark.read.schema(schema).csv(path, header=True)


def read_archive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A3: archived JSON responses, gzipped or not."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def stamped(df: DataFrame, chunk: Column, now: str | None = None) -> DataFrame:
    """`_chunk` and `_ingested_at` (naive UTC, whole seconds)."""
    at = F.lit(now).cast("timestamp_ntz") if now else F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")
    return df.withColumns({"_chunk": chunk, "_ingested_at": at})


def upserted(current: DataFrame, fresh: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of fresh replace those of current with the same keys; of equal keys in fresh the last in `order` stays."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    one = fresh.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    cond = [current[k].eqNullSafe(one[k]) for k in keys]
    return current.join(one.select(*keys), cond, "left_anti").unionByName(one)


def append_once(record: DataFrame | None, fresh: DataFrame, day: str, created: str, starts: str) -> tuple[DataFrame, str]:
    """Rows to append, and why there are none: nothing new or a time unknown, day on record, or made after its delivery began."""
    if fresh.isEmpty() or not fresh.filter(F.col(created).isNull() | F.col(starts).isNull()).isEmpty():
        return fresh.limit(0), "missing"
    if record is not None and not fresh.join(record.select(day), day, "left_semi").isEmpty():
        return fresh.limit(0), "recorded"
    late = fresh.agg((F.max(created) >= F.min(starts)).alias("late")).first().late
    return (fresh.limit(0), "late") if late else (fresh, "appended")


def formatted(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd, instants as ISO with Z, doubles to 4 places; all text."""
    shown = {"date": lambda c: F.date_format(c, "yyyy-MM-dd"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "double": lambda c: F.when(c.isNotNull(), F.format_string("%.4f", c))}
    return df.select(*[shown.get(t, lambda c: c.cast("string"))(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


def write_formatted(df: DataFrame, path: str) -> None:
    """As CSV with header; null is an empty field."""
    formatted(df).write.mode("overwrite").option("header", True).csv(path)


def read_formatted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The inverse of write_formatted; path may name a folder of such folders, one per day."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.schema(text).option("header", True).option("recursiveFileLookup", True).csv(path)
    read = lambda c, t: F.to_timestamp_ntz(F.regexp_replace(c, "[TZ]", " ")) if t == "timestamp_ntz" else c.cast(t)
    return rows.select(*[read(F.trim(F.col(f"`{f.name}`")), f.dataType.simpleString()).alias(f.name) for f in schema])


def fixture(df: DataFrame, path: str, keep: Column) -> None:
    """Rows that a predicate picks, sorted by all columns, as zstd Parquet."""
    df.filter(keep).orderBy(*[F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def layered(models: dict[str, tuple[str, DataFrame]], path: str) -> dict[str, DataFrame]:
    """Models in order; a `view` is named in the session, a `table` is also published under path and read back."""
    out = {}
    for name, (kind, df) in models.items():
        if kind == "table":
            publish(df, f"{path}/{name}")
            df = current(df.sparkSession, f"{path}/{name}", df.schema)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def mart(features: DataFrame, target: DataFrame, on: list[str], order: list[str], day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Features with the target where known, between optional days, in order of time."""
    return date_range(features, day, start, end).join(target, on, "left").orderBy(*order)


def date_range(df: DataFrame, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end; either bound may be missing."""
    bounds = [F.col(day) >= F.lit(start).cast("date")] if start else []
    bounds += [F.col(day) <= F.lit(end).cast("date")] if end else []
    for b in bounds:
        df = df.filter(b)
    return df


def load(df: DataFrame, path: str, today: str, days: int = 0) -> int:
    """Brings the chunks that recent_chunks names into a table of chunks, each in place of what it held; the version.

    A load that is run again changes nothing.
    """
    some = recent_chunks(df, today, days).select("_chunk")
    return write_chunks(df.join(some, "_chunk", "left_semi").select(*df.columns), path)


def write_results(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions as Parquet, metrics by fold as CSV."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/metrics")


def recent_chunks(df: DataFrame, today: str, days: int) -> DataFrame:
    """Chunks that end within the last days, and their rows."""
    end = F.to_date(F.element_at(F.split("_chunk", "-"), -1), "yyyyMMdd")
    return df.filter(end >= F.date_sub(F.lit(today).cast("date"), days)).groupBy("_chunk").agg(F.count("*").alias("rows"))


def aware(df: DataFrame) -> DataFrame:
    """Naive UTC timestamps as instants (the session's zone must be UTC)."""
    return df.select(*[F.col(f"`{n}`").cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(f"`{n}`") for n, t in df.dtypes])


def scd2(history: DataFrame, current: DataFrame, key: str, check: list[str], now: str) -> DataFrame:
    """History with versions closed whose row has changed or gone, and new versions opened.

    history has key, check columns, valid_from, valid_to (null while open).
    """
    at = F.lit(now).cast("timestamp_ntz")
    open_ = history.filter("valid_to is null")
    h, c = open_.alias("h"), current.select(key, *check).alias("c")
    same = F.lit(True)
    for x in check:
        same = same & F.col(f"h.{x}").eqNullSafe(F.col(f"c.{x}"))
    both = h.join(c, F.col(f"h.{key}") == F.col(f"c.{key}"), "full_outer").withColumn("_same", F.col(f"h.{key}").isNotNull() & F.col(f"c.{key}").isNotNull() & same)
    kept = both.filter(F.col(f"h.{key}").isNotNull()).select(f"h.{key}", *[f"h.{x}" for x in check], "h.valid_from", F.when(~F.col("_same"), at).alias("valid_to"))
    opened = both.filter(F.col(f"c.{key}").isNotNull() & ~F.col("_same")).select(f"c.{key}", *[f"c.{x}" for x in check], at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    closed = history.filter("valid_to is not null").select(key, *check, "valid_from", "valid_to")
    return closed.unionByName(kept).unionByName(opened)


def manifest(spark: SparkSession, path: str, largest: int = 1 << 30) -> DataFrame:
    """Path, bytes and SHA-256 of every file; null for one above `largest` bytes, which a row can't hold."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= largest).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.filter(F.col("length") > largest).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256")))


def outcome_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and rows by ingest outcome."""
    return chunks.groupBy("outcome").agg(F.count("*").alias("chunks"), F.sum("rows").alias("rows"))


def systematic_sample(df: DataFrame, every: int, order: list[str], by: list[str]) -> DataFrame:
    """Every n-th row in order within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") % every == 1).drop("_rn")
