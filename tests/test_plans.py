"""What reaches the scan."""

from tempograin.operators.aggregates import Query, aggregate
from tempograin.sources.adapters import event_gauge, table


def test_time_range_is_pushed_down(spark):
    made = aggregate(event_gauge(table(spark, "/root/testdata/sf0.001", "events")), "gauge", "average", Query(1704412800.0, 1706140800.0))
    plan = made._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in pushed and "LessThanOrEqual(ts,2024-01-25T00:00)" in pushed
    assert "user_id" not in plan[plan.index("ReadSchema") :]
