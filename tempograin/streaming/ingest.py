"""Ingest as a stream: late points, blocks and anchors by primary tag, with state.

The state of a primary tag is its active block and the latest anchor of each set of tags in it. Points of a micro-batch
are taken in order of arrival, by the rules of operators.coalesce. Each comes out with its block and anchor, or as late;
merged() makes stored points of them, at any time, so the stream never rewrites what it gave out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.coalesce import TYPES, block_starts, owners
from ..operators.points import VALUES

_STATE = "block_start bigint, anchors string"


def dealt(points: DataFrame, kind: str, datapoint_us: int, block_us: int, idle: float | None = None) -> DataFrame:
    """primary_tag, tags, t_us, seq, values, block_us, anchor_us, late of a stream of points with primary_tag.

    idle: seconds without points after which the state of a primary tag is dropped; its next point then begins a block.
    A task holds the points of one primary tag in one micro-batch, as they are put in order of arrival; the source bounds them
    (maxFilesPerTrigger over files of bounded size).
    """
    columns = ["primary_tag", "tags", "t_us", "seq", *VALUES[kind]]
    schema = f"primary_tag string, tags array<string>, t_us bigint, seq bigint, {TYPES[kind]}, block_us bigint, anchor_us bigint, late boolean"

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, known = state.get if state.exists else (None, "{}")
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        tagsets = rows["tags"].map(lambda tags: "\x01".join(sorted(tags)))
        # anchors of the active block arrive first
        before = sorted(json.loads(known).items(), key=lambda x: x[1])
        names = np.array([*(n for n, _ in before), *tagsets], object)
        time = np.array([*(t for _, t in before), *rows["t_us"]], np.int64)
        newest = np.maximum.accumulate(time)
        blocks = block_starts(newest, np.array([0, len(time)]), start, block_us)
        owner = owners(time, pd.factorize(names)[0], np.append(True, blocks[1:] != blocks[:-1]), datapoint_us)
        active = {names[o]: int(time[o]) for o in np.unique(owner[(blocks == blocks[-1]) & (owner >= 0)])}
        state.update((int(blocks[-1]), json.dumps(active)))
        if idle is not None:
            state.setTimeoutDuration(round(idle * 1000))
        late = owner[len(before) :] < 0
        pick = lambda x: pd.array(np.where(late, 0, x), "Int64")
        out = rows[columns].assign(block_us=pick(blocks[len(before) :]), anchor_us=pick(time[owner[len(before) :]]), late=late)
        out.loc[late, ["block_us", "anchor_us"]] = pd.NA
        yield out

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return points.select(*columns).groupBy("primary_tag").applyInPandasWithState(fold, schema, _STATE, "append", timeout)


def merged(rows: DataFrame, kind: str) -> DataFrame:
    """Stored points of what dealt() gave out."""
    values = [F.max_by("value", "seq").alias("value")] if kind == "gauge" else [F.sum(v).alias(v) for v in VALUES[kind]]
    keyed = rows.filter("not late").withColumn("tagset", F.array_sort("tags"))
    out = keyed.groupBy("primary_tag", "tagset", "block_us", "anchor_us").agg(F.min_by("tags", "seq").alias("tags"), F.min("seq").alias("seq"), *values)
    return out.select("primary_tag", "tags", "block_us", F.col("anchor_us").alias("t_us"), "seq", *VALUES[kind])


def windowed(points: DataFrame, window_us: int, start_us: int = 0) -> DataFrame:
    """window_us, n and sum of a stream of gauges by tumbling windows from start_us on; for a watermark, set one on a column event_time before."""
    size, offset = f"{window_us} microseconds", f"{start_us % window_us} microseconds"
    return points.groupBy(F.window("event_time", size, size, offset).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("sum")).select(F.unix_micros("w.start").alias("window_us"), "n", "sum")
