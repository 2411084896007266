"""Arithmetic and functions over aggregates of several metrics.

An expression is a tree of aggregates (leaf), numbers, arithmetic and functions. Leaves of one metric, group and range
become conditional aggregates of a single pass over its points; passes meet by inner joins on group and window, and the
tree itself is one Column over the joined row. A row without a value is left out, except for a single scalar.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Inputs, predicate
from ..functions.numbers import ARITHMETIC, call
from ..functions.tags import matches
from ..operators.aggregates import Query, in_range, measure, window_label, with_groups, with_window
from ..operators.points import SECOND


class UnexpectedResult(ValueError):
    """The parts of an expression have shapes that don't go together."""


@dataclasses.dataclass(frozen=True)
class Leaf:
    metric: str
    operation: str
    query: Query
    percentile: float | None = None


@dataclasses.dataclass(frozen=True)
class Number:
    value: float


@dataclasses.dataclass(frozen=True)
class Arithmetic:
    operation: str
    left: Expression
    right: Expression


@dataclasses.dataclass(frozen=True)
class Function:
    function: str
    arguments: Sequence[Expression]


Expression = Leaf | Number | Arithmetic | Function
#: From a metric's name, its Query and the window to its kind and points.
Points = Callable[[str, Query, float | None], tuple[str, DataFrame]]


def leaves(expression: Expression) -> list[Leaf]:
    if isinstance(expression, Leaf):
        return [expression]
    parts = (expression.left, expression.right) if isinstance(expression, Arithmetic) else expression.arguments if isinstance(expression, Function) else ()
    return [x for p in parts for x in leaves(p)]


def _value(expression: Expression, columns: dict[int, Column]) -> Column:
    if isinstance(expression, Leaf):
        return columns[id(expression)]
    if isinstance(expression, Number):
        return F.lit(float(expression.value))
    if isinstance(expression, Arithmetic):
        return ARITHMETIC[expression.operation](_value(expression.left, columns), _value(expression.right, columns))
    return call(expression.function, *(_value(a, columns) for a in expression.arguments)) if expression.arguments else F.lit(None).cast("double")


def _one_pass(own: list[tuple[str, Leaf]], points: Points, window: float | None) -> DataFrame:
    """group and window_us as far as they apply, and a column for each (name, leaf): leaves of one metric, group and range."""
    query = own[0][1].query
    # partitions may be left out only by a tag filter that all leaves have
    alike = all(x.query.tags_filter == query.tags_filter for _, x in own)
    kind, rows = points(own[0][1].metric, query if alike else dataclasses.replace(query, tags_filter=None), window)
    rows = in_range(rows, query)
    wanted = {n: matches(F.col("tags"), x.query.tags_filter) for n, x in own}
    if all(x.query.tags_filter not in (None, "None") for _, x in own):
        rows = rows.filter(reduce(or_, wanted.values()))
    rows = with_window(rows, query, window) if window is not None else rows
    rows = with_groups(rows, query.group_by) if query.group_by else rows
    seconds = int(window * SECOND) / SECOND if window is not None else query.end - query.start
    keys = ["group"] * bool(query.group_by) + ["window_us"] * (window is not None)
    made = rows.groupBy(*keys).agg(*(measure(kind, x.operation, x.query, seconds, x.percentile, wanted[n]).alias(n) for n, x in own), *(F.count_if(wanted[n]).alias(f"_n{n}") for n, _ in own))
    # a leaf has a row only where it has points
    return (made.filter(" and ".join(f"_n{n} > 0" for n, _ in own)) if keys else made).select(*keys, *(n for n, _ in own))


def compose(expression: Expression, points: Points, window: float | None = None, output_filter: object = None) -> DataFrame:
    """value; with group and window_start as far as the leaves have them. output_filter: a filter of the final values; a scalar that fails is null, other rows go."""
    all_leaves = leaves(expression)
    if not all_leaves:
        raise UnexpectedResult("an expression needs an aggregate")
    passes: dict[tuple, list[tuple[str, Leaf]]] = {}
    for i, x in enumerate(all_leaves):
        passes.setdefault((x.metric, tuple(x.query.group_by), x.query.range_us), []).append((f"v{i}", x))
    shapes = {bool(group) for _, group, _ in passes}
    if window is not None and len(shapes) > 1:
        raise UnexpectedResult("windows of groups and of all points don't go together")
    if len({len(group) for _, group, _ in passes if group}) > 1:
        raise UnexpectedResult("groups by different numbers of keys don't go together")
    made = [_one_pass(own, points, window) for _, own in sorted(passes.items(), key=lambda x: not x[0][1])]
    joined = made[0]
    for other in made[1:]:
        on = [k for k in ("group", "window_us") if k in joined.columns and k in other.columns]
        joined = joined.join(other, on) if on else joined.crossJoin(F.broadcast(other))  # without keys, other is a single row
    columns = {id(x): F.col(f"v{i}") for i, x in enumerate(all_leaves)}
    out = joined.withColumn("value", _value(expression, columns))
    if output_filter is not None:
        out = out.withColumn("value", F.when(predicate(output_filter, Inputs(F.col("value"))), F.col("value")))
    keys = ["group"] * ("group" in out.columns)
    if window is not None:
        return out.filter("value is not null").select(*keys, window_label().alias("window_start"), "window_us", "value")
    return out.filter("value is not null").select("group", "value") if keys else out.select("value")
