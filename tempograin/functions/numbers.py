"""Arithmetic, comparison, logic and functions over nullable doubles by IEEE rules.

Null is a missing value: any missing operand makes the result missing. NaN compares as unequal to everything, itself
included; division by zero gives an infinity or NaN, under ANSI mode too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def null() -> Column:
    return F.lit(None).cast("double")


def _missing(*values: Column) -> Column:
    out = values[0].isNull()
    for v in values[1:]:
        out = out | v.isNull()
    return out


def divide(left: Column, right: Column) -> Column:
    negative = (left < 0) != F.startswith(right.cast("string"), F.lit("-"))  # -0.0 equals 0.0 but for its text
    by_zero = F.when((left == 0) | F.isnan(left), float("nan")).when(negative, float("-inf")).otherwise(float("inf"))
    return F.when(_missing(left, right), null()).when(right == 0, by_zero).otherwise(F.try_divide(left, right))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "Add": lambda a, b: a + b,
    "Subtract": lambda a, b: a - b,
    "Multiply": lambda a, b: a * b,
    "Divide": divide,
}

_COMPARE = {
    "Equal": lambda a, b: a == b,
    "NotEqual": lambda a, b: a != b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
}


def compare(operation: str, left: Column, right: Column) -> Column:
    return F.when(_missing(left, right), F.lit(None).cast("boolean")).when(F.isnan(left) | F.isnan(right), F.lit(operation == "NotEqual")).otherwise(_COMPARE[operation](left, right))


def both(left: Column, right: Column) -> Column:
    """Logical and: missing if the left side is; the right side only matters if the left is true."""
    return F.when(left.isNull(), F.lit(None).cast("boolean")).when(~left, F.lit(False)).otherwise(right)


def either(left: Column, right: Column) -> Column:
    """Logical or: missing if the left side is, even if the right is true."""
    return F.when(left.isNull(), F.lit(None).cast("boolean")).when(left, F.lit(True)).otherwise(right)


def _whole(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    # Spark's floor and ceil give bigints; doubles from 2**52 on are whole
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(function(x).cast("double"))


def _positive(x: Column) -> Column:
    return (x > 0) & ~F.isnan(x)


#: name: (number of arguments, function)
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "Abs": (1, F.abs),
    "Max": (2, lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))),
    "Min": (2, lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))),
    "Round": (1, lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.round(x, 0))),
    "Ceil": (1, _whole(F.ceil)),
    "Floor": (1, _whole(F.floor)),
    "Sqrt": (1, lambda x: F.when((x >= 0) & ~F.isnan(x), F.sqrt(x))),
    "Square": (1, lambda x: x * x),
    "Power": (2, F.pow),
    "Exponential": (1, F.exp),
    "LogE": (1, lambda x: F.when(_positive(x), F.ln(x))),
    "LogBase": (2, lambda x, base: F.when(_positive(x) & _positive(base), divide(F.ln(x), F.ln(base)))),
    "Sin": (1, F.sin),
    "Cos": (1, F.cos),
    "Tan": (1, F.tan),
}


def call(name: str, *arguments: Column) -> Column:
    """A function by name; missing if an argument is, or if their number is wrong."""
    count, function = FUNCTIONS[name]
    return F.when(_missing(*arguments), null()).otherwise(function(*arguments)) if len(arguments) == count else null()
