"""Tags: an array of "key:value" strings on each point."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "default"


def checked(tag: str) -> str:
    """A tag as given, if it has exactly one colon."""
    if tag.count(":") != 1:
        raise ValueError(f"a tag is key:value, not {tag!r}")
    return tag


def _array(tags: Iterable[str]) -> Column:
    return F.array(*(F.lit(checked(t)) for t in tags)).cast("array<string>")


def has_any(tags: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, _array(wanted)), F.lit(False))


def has_all(tags: Column, wanted: Sequence[str]) -> Column:
    out = F.lit(True)
    for t in wanted:
        out = out & F.coalesce(F.array_contains(tags, checked(t)), F.lit(False))
    return out


def matches(tags: Column, spec: str | dict | None) -> Column:
    """spec: None or "None", {"And": tags}, {"Or": tags}, {"OrAnd": [tags, tags]}."""
    if spec in (None, "None"):
        return F.lit(True)
    ((kind, body),) = spec.items()
    if kind == "And":
        return has_all(tags, body)
    if kind == "Or":
        return has_any(tags, body)
    if kind == "OrAnd":
        return has_any(tags, body[0]) & has_any(tags, body[1])
    raise ValueError(f"unknown tag filter {kind}")


def values_of(tags: Column, key: str) -> Column:
    """The distinct values that a point has for a key."""
    own = F.filter(tags, lambda t: F.startswith(t, F.lit(f"{key}:")))
    return F.array_distinct(F.transform(own, lambda t: F.substr(t, F.lit(len(key) + 2))))


def primary_tag(tags: Column, named: Sequence[str] = (), keys: Sequence[str] = ()) -> Column:
    """The first tag, in a point's own order, that is named or whose key is in keys; else "default"."""
    of_key = lambda t: F.substring_index(t, ":", 1).isin(list(keys)) if keys else F.lit(False)
    eligible = F.filter(tags, lambda t: (t.isin(list(named)) if named else F.lit(False)) | of_key(t))
    return F.coalesce(F.get(eligible, F.lit(0)), F.lit(DEFAULT))


def possible_partitions(spec: str | dict | None, named: Sequence[str]) -> list[str] | None:
    """Primary tags whose partitions can hold a match if every point has at most one eligible tag; None for all of them."""
    if isinstance(spec, dict) and (own := [t for t in spec.get("And", ()) if t in named]):
        return own
    return None
