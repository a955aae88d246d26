"""Where queries register with the SQL that says the same, and what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeutil as t

ZONE = "Europe/London"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None, *dates: str):
    """Registers a query and its SQL, if any; dates are compared as text."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates}) if dates else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if dates else sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[r(c, n).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint", "smallint") else F.col(c) for c, k in df.dtypes])


#: Mean value and number of events per half-hour.
HALF_HOURS = """hh AS (SELECT date_trunc('hour', ts) + to_minutes(CAST(30 * (minute(ts) // 30) AS BIGINT)) AS start_utc, avg(value) AS price, count(*) AS n FROM events GROUP BY 1),
h AS (SELECT *, CAST(start_utc AS DATE) AS day, CAST(hour(start_utc) * 2 + minute(start_utc) // 30 + 1 AS BIGINT) AS period FROM hh)"""


def half_hour(ts: str) -> Column:
    return t.add_minutes(F.date_trunc("hour", ts).cast("timestamp_ntz"), F.floor(F.minute(ts) / 30) * 30)


def half_hours(spark: SparkSession, d: str) -> DataFrame:
    out = read(spark, d, "events").groupBy(half_hour("ts").alias("start_utc")).agg(F.avg("value").alias("price"), F.count("*").alias("n"))
    return out.withColumns({"day": F.col("start_utc").cast("date"), "period": (t.half_hour_slot("start_utc") + 1).cast("long")})
