"""The queries over whole tables leave no event out."""

from pyspark.sql import functions as F

from tempograin import queries as metrics

DATA = "/root/testdata/sf0.001"


def test_whole_range_holds_all_events(spark):
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    found = metrics.queries()
    assert found["count_sum_whole"](spark, DATA).collect()[0]["value"] == n > found["count_sum"](spark, DATA).collect()[0]["value"]
    for name in ("count_sum_window_whole", "count_sum_group_whole"):
        assert found[name](spark, DATA).agg(F.sum("value")).collect()[0][0] == n


def test_each_ranged_query_has_a_whole_one():
    found, sql = metrics.queries(), metrics.oracle_sql()
    ranged = {n for n in found if n.startswith(("gauge_", "ratio_", "count_", "expr_", "rollup_", "histogram_")) and not n.endswith("_whole")}
    assert ranged and all(f"{n}_whole" in found and (n in sql) == (f"{n}_whole" in sql) for n in ranged)
    assert not any(str(x) in sql[f"{n}_whole"] for n in ranged & set(sql) for x in (metrics._S, metrics._E, metrics._E - 1))


def test_whole_histogram_holds_all_values(spark):
    most = spark.read.parquet("/root/testdata/sf0.1/events.parquet").agg(F.min("value"), F.max("value")).collect()[0]
    low, high, _ = metrics.WHOLE_VALUES
    assert low <= most[0] and 500 < most[1] < high
