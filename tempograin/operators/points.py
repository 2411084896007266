"""Points of the three metric types, from any DataFrame.

Schemas: metric kind "gauge": value float; "count": count bigint; "ratio": num bigint, den bigint. Each has also
tags array<string>, t_us bigint (microseconds since the epoch), seq bigint (order of arrival). Points of a table with a time
column may keep it as ts; time ranges are then also asked of ts itself, which reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Largest count of one point, exclusive.
COUNT_LIMIT = 1 << 24
VALUES = {"gauge": ("value",), "count": ("count",), "ratio": ("num", "den")}


def micros(time: Column) -> Column:
    """Microseconds since the epoch of seconds as a number."""
    return F.round(time.cast("double") * SECOND).cast("long")


def micros_of_timestamp(time: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def tag(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}:"), value.cast("string"))


def _points(df: DataFrame, t_us: Column, tags: Column, seq: Column, ts: Column | None, *values: Column) -> DataFrame:
    return df.select(tags.alias("tags"), t_us.alias("t_us"), seq.alias("seq"), *values, *([] if ts is None else [ts.alias("ts")]))


def gauge(df: DataFrame, t_us: Column, value: Column, tags: Column, seq: Column, ts: Column | None = None) -> DataFrame:
    """Values are kept as 32-bit floats."""
    return _points(df, t_us, tags, seq, ts, value.cast("float").alias("value"))


def count(df: DataFrame, t_us: Column, amount: Column, tags: Column, seq: Column, ts: Column | None = None) -> DataFrame:
    return _points(df, t_us, tags, seq, ts, amount.cast("long").alias("count"))


def ratio(df: DataFrame, t_us: Column, num: Column, den: Column, tags: Column, seq: Column, ts: Column | None = None) -> DataFrame:
    return _points(df, t_us, tags, seq, ts, num.cast("long").alias("num"), den.cast("long").alias("den"))


def validated(points: DataFrame, kind: str) -> DataFrame:
    """points with a column rejected: why a point can't be stored, or null."""
    bad_tag = F.exists("tags", lambda t: t.isNull() | (F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit(""))) != 1))
    missing = F.col("t_us").isNull() | F.col("tags").isNull()
    for v in VALUES[kind]:
        missing = missing | F.col(v).isNull()
    reason = F.when(missing, "Missing").when(bad_tag, "InvalidTag")
    if kind != "gauge":
        for v in VALUES[kind]:
            reason = reason.when((F.col(v) < 0) | (F.col(v) >= COUNT_LIMIT), "TooLargeCount")
    return points.withColumn("rejected", reason)
