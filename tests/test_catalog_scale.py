"""Ingest of the catalog queries: ranges that reach the scan, metrics side by side, waiting points folded few times."""

import threading

import numpy as np
import pyarrow as pa
import pytest

from tempograin import stored_queries
from tempograin.operators import coalesce

DATA = "/root/testdata/sf0.001"


def test_batches_reach_the_scan_and_metrics_are_filled_side_by_side(spark, monkeypatch):
    plans, meet, ingest = [], threading.Barrier(3, timeout=120), stored_queries.MetricsEngine.ingest

    def watched(self, name, kind, points):
        if not any(n == name for n, _ in plans):
            meet.wait()  # breaks unless all three are under way
        plans.append((name, points._jdf.queryExecution().executedPlan().toString()))
        return ingest(self, name, kind, points)

    monkeypatch.setattr(stored_queries.MetricsEngine, "ingest", watched)
    engine = stored_queries._engine(spark, DATA, "gauge", "count", "ratio", near=77.0)
    assert len(plans) == 9
    assert all("GreaterThanOrEqual(event_id," in p and "LessThan(event_id," in p for _, p in plans)
    assert engine.points("count", stored_queries.Query(stored_queries.START, stored_queries.END))[1].agg({"count": "sum"}).first()[0] == 1000


@pytest.mark.parametrize("least", (1, 7, 1 << 16))
def test_waiting_points_are_folded_few_times(monkeypatch, least):
    """One block with a set of tags for each point: all wait until its end."""
    n, size, seen, fold = 4000, 10, [], coalesce._fold
    monkeypatch.setattr(coalesce, "FOLD_ROWS", least)
    monkeypatch.setattr(coalesce, "_fold", lambda rows, *more: (seen.append(rows.num_rows), fold(rows, *more))[1])
    i = np.arange(n)
    whole = pa.table({
        "primary_tag": pa.array(["p"] * n), "tags": pa.array([[f"k:{x}"] for x in i]), "t_us": pa.array(i), "seq": pa.array(i), "value": pa.array(i, pa.float32()),
        "_upto": pa.array(i), "_seed": pa.array([False] * n), "newest": pa.array([0] * n), "tagset": pa.array(i), "group": pa.array([0] * n),
    })
    made = list(coalesce._fold_groups("gauge", 5, 10 * n)(iter(whole.to_batches(max_chunksize=size))))
    assert sum(b.num_rows for b in made) == n
    assert sum(seen) <= 4 * n
