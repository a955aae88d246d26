
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_local(ts: ColumnLike, zone: str) -> Column:
    """H1: wall clock in a zone of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts))


def to_utc(local: ColumnLike, zone: str) -> Column:
    """H2: UTC of a wall clock; a repeated time is the later one, a skipped one moves to the end of the gap.

    Works for gaps and repeats of any whole minutes up to a day, as the zone has them.
    """
    local = _c(local)
    early = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    offset = lambda t: F.timestamp_diff("MINUTE", t, to_local(t, zone))
    later = add_minutes(local, -offset(early + F.expr("INTERVAL 1 DAY")))
    # in a gap `early` has the offset behind it: go back minute by minute, in halving steps, as far as that holds
    steps = F.array(*[F.lit(1 << k) for k in range(10, -1, -1)])
    gap_end = F.aggregate(steps, F.date_trunc("minute", early).cast("timestamp_ntz"), lambda t, n: F.when(offset(add_minutes(t, -n)) == offset(early), add_minutes(t, -n)).otherwise(t))
    return F.when(to_local(early, zone) != local, gap_end).when((later > early) & (to_local(later, zone) == local), later).otherwise(early)


def day_start_utc(day: ColumnLike, zone: str) -> Column:
    """UTC instant at which a local calendar day begins."""
    return to_utc(_c(day).cast("timestamp_ntz"), zone)


def cutoff_utc(day: ColumnLike, zone: str, hour: int = 9, days_before: int = 1) -> Column:
    """Decision time: `hour` o'clock local, `days_before` days before the delivery day."""
    return to_utc(F.date_sub(_c(day), days_before).cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOUR"), zone)


def minutes_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """H6: minutes from earlier to later, as a double."""
    return F.timestamp_diff("SECOND", _c(earlier), _c(later)) / 60.0


def add_minutes(ts: ColumnLike, minutes: Column | int) -> Column:
    """H4."""
    return F.timestamp_add("MINUTE", F.lit(minutes) if isinstance(minutes, int) else minutes, _c(ts))


def iso_weekday(day: ColumnLike) -> Column:
    """H8: 1 for Monday to 7 for Sunday."""
    return F.weekday(_c(day)) + 1


def fractional_hour(ts: ColumnLike) -> Column:
    """H12."""
    return F.hour(_c(ts)) + F.minute(_c(ts)) / 60.0


def half_hour_slot(ts: ColumnLike) -> Column:
    """0 to 47 on the clock of ts."""
    return (F.hour(_c(ts)) * 2 + F.floor(F.minute(_c(ts)) / 30)).cast("int")


def periods_in_day(day: ColumnLike, zone: str) -> Column:
    """Half-hours of a local day: 46, 48 or 50."""
    return (F.timestamp_diff("MINUTE", day_start_utc(day, zone), day_start_utc(F.date_add(_c(day), 1), zone)) / 30).cast("int")


def settlement_day(ts: ColumnLike, zone: str) -> Column:
    """Local delivery day of a UTC timestamp."""
    return to_local(ts, zone).cast("date")


def settlement_period(ts: ColumnLike, zone: str) -> Column:
    """Number of the half-hour in its local day, from 1."""
    since = F.timestamp_diff("MINUTE", day_start_utc(settlement_day(ts, zone), zone), _c(ts))
    return (F.floor(since / 30) + 1).cast("int")


def chunk_start(day: ColumnLike, days: int, epoch: str = "2000-01-01") -> Column:
    """First day of the aligned chunk of `days` days that holds a day."""
    past = F.date_diff(_c(day), F.lit(epoch).cast("date"))
    return F.date_sub(_c(day), F.pmod(past, F.lit(days)))


def chunk_key(day: ColumnLike, days: int, epoch: str = "2000-01-01") -> Column:
    """yyyyMMdd-yyyyMMdd of that chunk."""
    first = chunk_start(day, days, epoch)
    return F.concat(F.date_format(first, "yyyyMMdd"), F.lit("-"), F.date_format(F.date_add(first, days - 1), "yyyyMMdd"))


def date_chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(chunk_start, chunk_end), consecutive and the last one cut at `end`."""
    one = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL {days} DAY)) AS chunk_start")
    return one.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date")))


def tomorrow(now: ColumnLike, zone: str) -> Column:
    """The local day after the one that `now` (UTC) falls on."""
    return F.date_add(settlement_day(now, zone), 1)


def month_rolls_over(a: ColumnLike, b: ColumnLike) -> Column:
    """Whether two days fall in different months."""
    return F.date_format(_c(a), "yyyy-MM") != F.date_format(_c(b), "yyyy-MM")


def parse_iso(text: ColumnLike) -> Column:
    """Naive UTC of an ISO-8601 text ending in Z; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(_c(text), "Z$", "+00:00")).cast("timestamp_ntz")


def format_iso(ts: ColumnLike) -> Column:
    """H24."""
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def quarter_label(day: ColumnLike) -> Column:
    """Like 2024Q3."""
    return F.concat(F.year(_c(day)).cast("string"), F.lit("Q"), F.quarter(_c(day)).cast("string"))


def week_ending(day: ColumnLike) -> Column:
    """The Sunday on which the ISO week of a day ends."""
    return F.date_add(_c(day), 6 - F.weekday(_c(day)))


def power_curve(speed: ColumnLike, cut_in: float = 3.0, rated: float = 12.0, cut_out: float = 25.0) -> Column:
    """Share of rated output: 0, cubic, 1, 0 beyond cut-out; null stays null."""
    v = _c(speed)
    return F.when(v.isNull(), F.lit(None)).when((v < cut_in) | (v >= cut_out), 0.0).when(v >= rated, 1.0).otherwise(F.pow((v - cut_in) / (rated - cut_in), 3))


def hour_group(hour: ColumnLike, groups: dict[str, tuple[int, int]], other: str = "other") -> Column:
    """Name of the first group whose [from, to) holds the hour."""
    out = F.lit(other)
    for name, (lo, hi) in reversed(groups.items()):
        out = F.when((_c(hour) >= lo) & (_c(hour) < hi), F.lit(name)).otherwise(out)
    return out


def archive_year(text: ColumnLike) -> Column:
    """The first run of four digits that stands alone in a text, as a number; null if there is none."""
    return F.regexp_extract(_c(text), r"(?:^|\D)(\d{4})(?:\D|$)", 1).try_cast("int")


def now_utc(fixed: str | None = None) -> Column:
    """H7: the present as naive UTC, or a fixed text in its place."""
    return F.lit(fixed).cast("timestamp_ntz") if fixed else F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"))


def newest(*columns: ColumnLike) -> Column:
    """Latest of several times, nulls left out."""
    return F.greatest(*[_c(x) for x in columns])


def sorted_row(columns: list[str]) -> dict[str, Column]:
    """The same columns with each row's values in ascending order (nulls last)."""
    whole = F.array_sort(F.array(*columns))
    return {c: whole[k] for k, c in enumerate(columns)}


def quantile_name(q: float) -> str:
    """p10 for 0.1."""
    return f"p{round(q * 100):02d}"
