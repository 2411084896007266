"""Known results over the whole sample series of a week."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.operators.aggregates import Query
from tempograin.operators.points import SECOND
from tempograin.plans.compose import Arithmetic, Leaf, Number
from tempograin.sources.catalog import MetricsEngine
from tempograin.sources.samples import START, sample_series, write_series

S = START + 6 * 86_400
E = S + 7_200


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    times, values = sample_series()
    assert len(times) == 12_101_966
    n = int(np.searchsorted(times, round((E + 3_600) * SECOND))) + 1
    path = str(tmp_path_factory.mktemp("series") / "series.parquet")
    write_series(path, times[:n], values[:n])
    tag = F.when(F.col("odd") == 1, "tag:T2").otherwise("tag:T1")
    return spark.read.parquet(path).withColumn("tags", F.array(tag))


def near(x):
    return pytest.approx(x, rel=1e-12)


def test_gauge_with_secondary_tags(spark, series, tmp_path):
    engine = MetricsEngine(spark, str(tmp_path))
    engine.create_metric("cpu", "gauge")
    engine.ingest("cpu", "gauge", series.select("tags", "t_us", "seq", "value"))
    engine = MetricsEngine(spark, str(tmp_path))
    one = lambda op, *a, **o: engine.aggregate("cpu", op, Query(S, E, exact=True, **o), *a).first()["value"]
    assert one("average") == near(0.6676946286179699)
    assert one("average", tags_filter={"And": ["tag:T1"]}) == near(0.6676941904100635)
    assert one("average", input_transform={"Function": {"function": "Sqrt", "arguments": ["InputValue"]}}) == near(0.8142835195822643)
    assert one("max") == near(0.8197603225708008)
    assert one("percentile", None, 95) == pytest.approx(0.800548324945819, abs=5e-4)
    groups = {r["group"][0]: r["value"] for r in engine.aggregate("cpu", "average", Query(S, E, group_by=("tag",))).collect()}
    assert groups == {"T1": near(0.6676941904100635), "T2": near(0.6676950667588899)}
    assert engine.compose(Arithmetic("Multiply", Number(100), Leaf("cpu", "average", Query(S, E)))).first()["value"] == near(66.769462861797)
    windows = engine.aggregate("cpu", "average", Query(S, E), 500.0).orderBy("window_us").collect()
    assert len(windows) == 14


def test_count_with_primary_tags(spark, series, tmp_path):
    engine = MetricsEngine(spark, str(tmp_path))
    engine.create_metric("hits", "count")
    engine.add_auto_primary_tag("hits", "tag")
    engine.ingest("hits", "count", series.select("tags", "t_us", "seq", F.lit(1).cast("long").alias("count")))
    one = lambda op, **o: engine.aggregate("hits", op, Query(S, E, **o)).first()["value"]
    assert one("sum") == 144_338 and one("sum", tags_filter={"Or": ["tag:T1", "tag:T2"]}) == 144_338
    assert one("sum", tags_filter={"And": ["tag:T1"]}) == 72_169
    assert one("average") == near(20.046944444444446)
