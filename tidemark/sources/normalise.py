"""Nested payloads as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import add_minutes, parse_iso, to_utc


def record_list(payload: DataFrame, path: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per record of an array; fields maps new names to (old name, type); `iso` reads ISO instants."""
    rows = payload.select(F.explode(path).alias("r"))
    cast = lambda old, kind: parse_iso(F.col(f"r.{old}")) if kind == "iso" else F.col(f"r.{old}").cast(kind)
    return rows.select(*[cast(old, kind).alias(new) for new, (old, kind) in fields.items()])


def json_fields(df: DataFrame, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields of a column of JSON text as typed columns; new name -> (path without $., type). Null where the text or the type doesn't fit."""
    return df.withColumns({new: F.get_json_object(text, f"$.{path}").try_cast(kind) for new, (path, kind) in fields.items()})


def embedded_issue_time(text: Column, clock: Column, zone: str = "Europe/London") -> tuple[Column, Column]:
    """Issue time in UTC and its basis: with a short clock (HH:MM) the text is UTC, else local time."""
    raw = F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" "))).cast("timestamp_ntz")
    short = F.length(clock) == 5
    return F.when(short, raw).otherwise(to_utc(raw, zone)), F.when(short, F.lit("utc")).otherwise(F.lit("local"))


def period_start(day: Column, clock: Column, minutes: int = 30) -> Column:
    """Start of a period given by the day and the clock at its end."""
    padded = F.lpad(F.substring(clock, 1, 5), 5, "0")
    return add_minutes(F.try_to_timestamp(F.concat_ws(" ", F.substring(day, 1, 10), padded)).cast("timestamp_ntz"), -minutes)


def parallel_arrays(payload: DataFrame, variables: list[str], leads: list[int], suffix: str = "_previous_day") -> DataFrame:
    """A10: one row per location, lead and time of responses with parallel hourly arrays; all-null rows are dropped."""
    per = payload.select("model", F.posexplode("responses").alias("k", "resp"), "location_ids")
    per = per.withColumn("location_id", F.element_at("location_ids", F.col("k") + 1))
    out = None
    for lead in leads:
        names = ["time", *[f"{v}{suffix}{lead}" for v in variables]]
        zipped = per.select("model", "location_id", F.inline(F.arrays_zip(*[F.col(f"resp.hourly.{n}").alias(n) for n in names])))
        valid = F.try_to_timestamp(F.replace(F.col("time"), F.lit("T"), F.lit(" "))).cast("timestamp_ntz")
        rows = zipped.select("model", "location_id", F.lit(lead).alias("lead_days"), valid.alias("valid_time"), *[F.col(n).cast("double").alias(v) for n, v in zip(names[1:], variables, strict=True)])
        out = rows if out is None else out.unionByName(rows)
    available = F.col("valid_time") - F.make_dt_interval(F.col("lead_days")) + F.expr("INTERVAL 6 HOUR")
    return out.na.drop("all", subset=variables).withColumn("available_at", available)


def nested_intensity(payload: DataFrame) -> DataFrame:
    """Flattened struct, numbers that can't be read as null."""
    r = payload.select(F.explode("data").alias("r"))
    number = lambda c: F.col(c).try_cast("double")
    return r.select(
        parse_iso(F.regexp_replace("r.from", "Z$", ":00Z")).alias("start_time"),
        parse_iso(F.regexp_replace("r.to", "Z$", ":00Z")).alias("end_time"),
        number("r.intensity.forecast").alias("intensity_forecast"),
        number("r.intensity.actual").alias("intensity_actual"),
        F.col("r.intensity.index").alias("intensity_index"),
    )


def embedded_forecasts(rows: DataFrame, issued: str, clock: str, day: str, ends: str, values: dict[str, str], zone: str = "Europe/London") -> DataFrame:
    """issued_at (UTC), basis, start_utc and the values as numbers (new name -> old), null where a text is none.

    Day and the clock at a period's end are local. Rows without issue time or start are dropped.
    """
    at, basis = embedded_issue_time(F.col(issued), F.col(clock), zone)
    start = to_utc(period_start(F.col(day), F.col(ends)), zone)
    out = rows.select(at.alias("issued_at"), basis.alias("basis"), start.alias("start_utc"), *[F.col(old).try_cast("double").alias(new) for new, old in values.items()])
    return out.dropna(subset=["issued_at", "start_utc"])
