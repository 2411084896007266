"""The JSON form of queries and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import Query
from .compose import Arithmetic, Expression, Function, Leaf, Number

_LEAVES = ("Average", "Sum", "Max", "Min", "Percentile")


def query_of(body: dict, start: float, end: float) -> Query:
    """A Query; the request's time range takes the place of its own."""
    keys = body.get("group_by") or ()
    options = {k: body[k] for k in ("tags_filter", "input_filter", "input_transform", "output_filter", "output_transform", "remove_empty_datapoints") if k in body}
    return Query(start, end, group_by=(keys,) if isinstance(keys, str) else tuple(keys), **options)


def expression_of(body: dict, start: float, end: float) -> Expression:
    ((kind, x),) = body.items()
    if kind in _LEAVES:
        return Leaf(x["metric"], kind.lower(), query_of(x.get("query", {}), start, end), x.get("percentile"))
    if kind == "Value":
        return Number(float(x))
    if kind == "Arithmetic":
        return Arithmetic(x["operation"], expression_of(x["left"], start, end), expression_of(x["right"], start, end))
    if kind == "Function":
        return Function(x["function"], tuple(expression_of(a, start, end) for a in x["arguments"]))
    raise ValueError(f"unknown expression {kind}")


def request_of(text: str | dict) -> tuple[Expression, float | None]:
    """(expression, window) of {"time_range": {"start", "end"}, "duration"?, "expression"}."""
    body = json.loads(text) if isinstance(text, str) else text
    span = body["time_range"]
    return expression_of(body["expression"], span["start"], span["end"]), body.get("duration")


def result_json(result: DataFrame) -> DataFrame:
    """One column json: a row for each group, in their order, as [group, result]; else one row. A result is a number or null, or [window_start, value] pairs. A group of one key is a string."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    bare = lambda array: F.substr(array, F.lit(2), F.length(array) - 2)
    keys = ["group"] * ("group" in result.columns)
    if "window_start" in result.columns:
        pairs = F.array_sort(F.collect_list(F.struct("window_us", F.array("window_start", finite).alias("pair"))))
        made = result.groupBy(*keys).agg(F.to_json(F.transform(pairs, lambda x: x["pair"])).alias("made"))
    else:
        made = result.select(*keys, bare(F.to_json(F.array(finite))).alias("made"))
    if not keys:
        return made.select(F.col("made").alias("json"))
    group = F.when(F.size("group") == 1, bare(F.to_json("group"))).otherwise(F.to_json("group"))
    return made.orderBy("group").select(F.concat(F.lit("["), group, F.lit(","), "made", F.lit("]")).alias("json"))
