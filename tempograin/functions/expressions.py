"""Transforms and filters over a point or an aggregate.

Each is a Python function from Inputs to a Column, or the same as a JSON value:
  transform: "InputValue", "InputNumerator", "InputDenominator", {"Value": number},
    {"Arithmetic": {"operation", "left", "right"}}, {"Function": {"function", "arguments"}}
  filter: {"Value": transform}, {"Compare": {"operation", "left", "right"}}, {"And": {"left", "right"}}, {"Or": ...}
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ARITHMETIC, both, call, compare, divide, either, null


class Inputs(NamedTuple):
    """What an expression sees; numerator and denominator are missing unless it is a ratio."""

    value: Column
    numerator: Column | None = None
    denominator: Column | None = None


Expression = Callable[[Inputs], Column] | dict | str


def ratio(numerator: Column, denominator: Column) -> Inputs:
    """A ratio without a denominator has no value."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return Inputs(F.when(d != 0, divide(n, d)), n, d)


def transform(expression: Expression, inputs: Inputs) -> Column:
    if callable(expression):
        return expression(inputs)
    if isinstance(expression, str):
        found = {"InputValue": inputs.value, "InputNumerator": inputs.numerator, "InputDenominator": inputs.denominator}[expression]
        return null() if found is None else found
    ((kind, body),) = expression.items()
    if kind == "Value":
        return F.lit(float(body))
    if kind == "Arithmetic":
        return ARITHMETIC[body["operation"]](transform(body["left"], inputs), transform(body["right"], inputs))
    if kind == "Function":
        return call(body["function"], *(transform(a, inputs) for a in body["arguments"]))
    raise ValueError(f"unknown transform {kind}")


def predicate(expression: Expression, inputs: Inputs) -> Column:
    """True or false; a missing outcome is false."""
    return F.coalesce(expression(inputs) if callable(expression) else _logic(expression, inputs), F.lit(False))


def _logic(expression: dict, inputs: Inputs) -> Column:
    ((kind, body),) = expression.items()
    if kind == "Value":  # a bare number is no truth value
        return F.lit(None).cast("boolean")
    if kind == "Compare":
        sides = [transform(body[s]["Value"], inputs) if "Value" in body[s] else null() for s in ("left", "right")]
        return compare(body["operation"], *sides)
    if kind in ("And", "Or"):
        return (both if kind == "And" else either)(_logic(body["left"], inputs), _logic(body["right"], inputs))
    raise ValueError(f"unknown filter {kind}")
