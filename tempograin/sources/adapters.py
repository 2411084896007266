"""Points from tables and from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import points as P

#: Columns of one JSON line for each kind; ratio is [numerator, denominator].
JSON_LINES = {"gauge": "time double, value double, tags array<string>", "count": "time double, count bigint, tags array<string>", "ratio": "time double, ratio array<bigint>, tags array<string>"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def json_points(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Points of JSON lines {"time", "value" | "count" | "ratio", "tags"}; arrival is by file and line."""
    rows = spark.read.schema(JSON_LINES[kind]).json(path)
    t, seq = P.micros(F.col("time")), F.monotonically_increasing_id()
    if kind == "gauge":
        return P.gauge(rows, t, F.col("value"), F.col("tags"), seq)
    if kind == "count":
        return P.count(rows, t, F.col("count"), F.col("tags"), seq)
    return P.ratio(rows, t, F.get("ratio", F.lit(0)), F.get("ratio", F.lit(1)), F.col("tags"), seq)


def event_gauge(events: DataFrame) -> DataFrame:
    return P.gauge(events, P.micros_of_timestamp(F.col("ts")), F.col("value"), _event_tags(), F.col("event_id"), F.col("ts"))


def event_count(events: DataFrame) -> DataFrame:
    return P.count(events, P.micros_of_timestamp(F.col("ts")), F.lit(1), _event_tags(), F.col("event_id"), F.col("ts"))


def event_ratio(events: DataFrame) -> DataFrame:
    """Errors over all events."""
    return P.ratio(events, P.micros_of_timestamp(F.col("ts")), (F.col("event_type") == "error").cast("long"), F.lit(1), _event_tags(), F.col("event_id"), F.col("ts"))


def _event_tags():
    return F.array(P.tag("event_type", F.col("event_type")), P.tag("user", F.col("user_id")))


def lineitem_gauge(lineitem: DataFrame) -> DataFrame:
    tags = F.array(P.tag("flag", F.col("l_returnflag")), P.tag("status", F.col("l_linestatus")))
    return P.gauge(lineitem, P.micros_of_timestamp(F.col("l_shipdate")), F.col("l_extendedprice"), tags, F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_shipdate"))


def lineitem_ratio(lineitem: DataFrame) -> DataFrame:
    """Returned quantity over all quantity."""
    tags = F.array(P.tag("flag", F.col("l_returnflag")), P.tag("status", F.col("l_linestatus")))
    return P.ratio(lineitem, P.micros_of_timestamp(F.col("l_shipdate")), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0), F.col("l_quantity"), tags, F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_shipdate"))
