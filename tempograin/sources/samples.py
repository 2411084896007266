"""The sample series: a slow sine with noise, at random times of 20 points a second, as Parquet files.

The same seed gives the same series wherever numpy's legacy generator is used; the draws are one after another, so this is a
sequential job of some twenty seconds for a week.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

START, WEEK, RATE = 1654077600.0, 7 * 86_400.0, 20.0


def sample_series(seed: int = 1337, start: float = START, seconds: float = WEEK, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, values as 32-bit floats)."""
    draw = np.random.RandomState(seed)
    normal, exponential, sin = draw.normal, draw.exponential, math.sin
    times, values, now, end, gap = [], [], start, start + seconds, 1.0 / rate
    while now < end:
        times.append(now)
        values.append(0.5 + 0.3 * (1.0 + sin(0.001 * now)) * 0.5 + normal(scale=0.005))
        now += exponential(gap)
    return np.round(np.array(times) * 1e6).astype(np.int64), np.clip(np.array(values), 0.0, 1.0).astype(np.float32)


def write_series(path: str, times: np.ndarray, values: np.ndarray) -> None:
    """seq, t_us, value, odd (of seq) in one local file, in row groups of a million."""
    seq = np.arange(len(times))
    pq.write_table(pa.table({"seq": seq, "t_us": times, "value": values, "odd": (seq % 2).astype(np.int32)}), path, row_group_size=1_000_000)
