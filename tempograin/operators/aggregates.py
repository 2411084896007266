"""Aggregates of points over a time range: whole or by tumbling windows, of all points or by tag values.

A range holds its start and its end. Windows start at the range's start; what doesn't fill a whole window at the
end is left out. A window's label is its start in whole seconds. Points with several values of a key count in each of
their groups. A range without points has sum 0 and no other value.
"""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.expressions import Expression, Inputs, predicate, ratio, transform
from ..functions.tags import matches, values_of
from .points import SECOND

OPERATIONS = ("average", "sum", "max", "min", "percentile")
ACCURACY = 10_000
EPOCH = datetime.datetime(1970, 1, 1)


class NotSupported(ValueError):
    """The metric type doesn't have this operation or option."""


@dataclasses.dataclass(frozen=True)
class Query:
    """What to aggregate of a metric. start and end in seconds; exact: an exact percentile, which holds all distinct values of a group."""

    start: float
    end: float
    tags_filter: str | dict | None = None
    input_filter: Expression | None = None
    input_transform: Expression | None = None
    output_filter: Expression | None = None
    output_transform: Expression | None = None
    group_by: Sequence[str] = ()
    remove_empty_datapoints: bool = True
    exact: bool = False

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError("a range ends after its start")
        if len(set(self.group_by)) < len(self.group_by):
            raise ValueError("a key can be grouped by once only")

    @property
    def range_us(self) -> tuple[int, int]:
        return round(self.start * SECOND), round(self.end * SECOND)


def in_range(points: DataFrame, query: Query) -> DataFrame:
    start, end = query.range_us
    inside = points.filter((F.col("t_us") >= start) & (F.col("t_us") <= end))
    if isinstance(points.schema["ts"].dataType if "ts" in points.columns else None, TimestampNTZType):
        # the same condition on the stored column, which the scan can use
        at = lambda us: F.lit(str(EPOCH + datetime.timedelta(microseconds=us))).cast("timestamp_ntz")
        inside = inside.filter((F.col("ts") >= at(start)) & (F.col("ts") <= at(end)))
    return inside


def inputs_of(kind: str) -> Inputs:
    if kind == "ratio":
        return ratio(F.col("num"), F.col("den"))
    return Inputs(F.col("value" if kind == "gauge" else "count").cast("double"))


def _aggregate(operation: str, x: Column, query: Query, percentile: float | None) -> Column:
    if operation == "average":
        return F.avg(x)
    if operation == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if operation in ("max", "min"):
        return (F.max if operation == "max" else F.min)(F.when(~F.isnan(x), x))
    if operation == "percentile" and percentile is not None:
        share = F.lit(percentile / 100)
        return F.percentile(x, share) if query.exact else F.percentile_approx(x, share, F.lit(ACCURACY))
    raise ValueError(f"unknown operation {operation}")


def measure(kind: str, operation: str, query: Query, seconds: float, percentile: float | None = None, where: Column | None = None) -> Column:
    """The aggregate as a Column for agg(). seconds: length of what a count's rate is over; where: other conditions on points."""
    inputs = inputs_of(kind)
    if kind == "count" and (operation not in ("sum", "average") or query.input_filter is not None or query.input_transform is not None):
        raise NotSupported(f"count has no {operation} with these options")
    if kind == "ratio" and query.input_transform is not None:
        raise NotSupported("ratio has no input transform")
    passed = F.lit(True) if where is None else where
    if query.input_filter is not None:
        passed = passed & predicate(query.input_filter, inputs)
    keep = lambda x: F.when(passed, x)
    if kind == "ratio" and operation == "sum":
        result = ratio(F.sum(keep(F.col("num"))), F.sum(keep(F.col("den"))))
    elif kind == "count":
        total = F.coalesce(F.sum(keep(F.col("count"))), F.lit(0)).cast("double")
        result = Inputs(total / F.lit(seconds) if operation == "average" else total)
    else:
        value = transform(query.input_transform, inputs) if query.input_transform is not None else inputs.value
        result = Inputs(_aggregate(operation, keep(value), query, percentile))
    out = transform(query.output_transform, result) if query.output_transform is not None else result.value
    return F.when(predicate(query.output_filter, result), out) if query.output_filter is not None else out


def window_count(query: Query, window: float) -> tuple[int, int]:
    """(microseconds of a window, number of whole windows)."""
    start, end = query.range_us
    step = int(window * SECOND)
    if step <= 0:
        raise ValueError("a window is longer than nothing")
    return step, (end - start) // step


def with_window(points: DataFrame, query: Query, window: float) -> DataFrame:
    """points of whole windows, with a column window_us: the start of each one's window."""
    start, _ = query.range_us
    step, n = window_count(query, window)
    return points.filter(F.col("t_us") < start + n * step).withColumn("window_us", F.expr(f"(t_us - {start}L) div {step}L * {step}L + {start}L"))


def with_groups(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points with a column group: values of the keys; a row for each combination that a point has, none if it lacks a key."""
    out = points
    for i, key in enumerate(keys):
        out = out.withColumn(f"_group{i}", F.explode(values_of(F.col("tags"), key)))
    return out.withColumn("group", F.array(*(F.col(f"_group{i}") for i in range(len(keys))))).drop(*(f"_group{i}" for i in range(len(keys))))


def window_label(column: str = "window_us") -> Column:
    return F.expr(f"{column} div {SECOND}L").cast("double")


def group_universe(points: DataFrame, keys: Sequence[str], tags_filter: str | dict | None = None) -> DataFrame:
    """group: every combination of the keys' values among points of any time that pass the tag filter."""
    own = points.filter(matches(F.col("tags"), tags_filter))
    out = None
    for i, key in enumerate(keys):
        values = own.select(F.explode(values_of(F.col("tags"), key)).alias(f"_group{i}")).distinct()
        out = values if out is None else out.crossJoin(values)
    return out.select(F.array(*(F.col(f"_group{i}") for i in range(len(keys)))).alias("group"))


def aggregate(points: DataFrame, kind: str, operation: str, query: Query, window: float | None = None, percentile: float | None = None, include_empty_groups: bool = False) -> DataFrame:
    """value; with group (array of values) if grouped, and window_start and window_us if by windows. Empty windows and rows without a value are left out unless asked for."""
    rows = in_range(points, query).filter(matches(F.col("tags"), query.tags_filter))
    rows = with_window(rows, query, window) if window is not None else rows
    rows = with_groups(rows, query.group_by) if query.group_by else rows
    seconds = int(window * SECOND) / SECOND if window is not None else query.end - query.start
    keys = ["group"] * bool(query.group_by) + ["window_us"] * (window is not None)
    out = rows.groupBy(*keys).agg(measure(kind, operation, query, seconds, percentile).alias("value"))
    if query.group_by and include_empty_groups and window is None:
        empty = F.lit(0.0 if operation == "sum" and kind != "ratio" else None).cast("double")
        out = group_universe(points, query.group_by, query.tags_filter).join(out.withColumn("_seen", F.lit(True)), "group", "left")
        out = out.select("group", F.when(F.col("_seen"), F.col("value")).otherwise(empty).alias("value"))
    if window is None:
        return out
    if query.remove_empty_datapoints:
        out = out.filter("value is not null")
    else:
        out = fill_windows(out, query, window)
    return out.select(*(k for k in keys if k == "group"), window_label().alias("window_start"), "window_us", "value")


def fill_windows(out: DataFrame, query: Query, window: float) -> DataFrame:
    """out with a row without a value for each window (of each group) that has none."""
    start, _ = query.range_us
    step, n = window_count(query, window)
    spine = out.sparkSession.range(start, start + n * step, step).select(F.col("id").alias("window_us"))
    if "group" in out.columns:
        spine = out.select("group").distinct().select("group", F.explode(F.sequence(F.lit(start), F.lit(start + (n - 1) * step), F.lit(step))).alias("window_us")) if n else out.select("group", "window_us").limit(0)
    return spine.join(out, [c for c in ("group", "window_us") if c in spine.columns], "left")
