"""Registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored_queries
from .functions.numbers import ARITHMETIC, FUNCTIONS, both, call, compare, either
from .functions.tags import primary_tag
from .operators import statistics
from .operators.aggregates import Query, aggregate
from .operators.coalesce import coalesce_points, reject_late
from .operators.points import SECOND
from .plans.compose import Arithmetic, Expression, Function, Leaf, Number, compose
from .sources.adapters import event_count, event_gauge, event_ratio, lineitem_gauge, lineitem_ratio, table

START, END, DAY = 1704412800.0, 1706140800.0, 86400.0
_S, _E, _D = (round(x * SECOND) for x in (START, END, DAY))
#: A range and histogram bounds that hold whole tables of events.
WHOLE, WHOLE_VALUES = (1704067200.0, 1735689600.0), (0, 10_000, 1_000)
#: Coalescing over events, which come every few minutes.
NEAR, BLOCK = 900 * SECOND, 6 * 3600 * SECOND

KINDS = {"gauge": event_gauge, "count": event_count, "ratio": event_ratio}
ABOVE_100 = {"Compare": {"operation": "GreaterThan", "left": {"Value": "InputValue"}, "right": {"Value": {"Value": 100.0}}}}
SQRT = {"Function": {"function": "Sqrt", "arguments": ["InputValue"]}}
MANY_DENOMINATORS = {"Compare": {"operation": "GreaterThan", "left": {"Value": "InputDenominator"}, "right": {"Value": {"Value": 3.0}}}}
BY_TYPE = ("event_type",)
AND = {"And": ["event_type:click", "user:3"]}
OR = {"Or": ["event_type:click", "user:3"]}
OR_AND = {"OrAnd": [["event_type:click", "event_type:view"], ["user:3", "user:4", "user:5"]]}

_P = """with p as (select event_id as seq, epoch_us(ts) as t, value::float::double as v, event_type, user_id, (event_type = 'error')::int as num from events),
r as (select * from p where t between {s} and {e}), w as (select *, ((t - {s}) // {d}) * {d} + {s} as w from r where t < {s} + (({e} - {s}) // {d}) * {d}) """.format(s=_S, e=_E, d=_D)
_WINDOW = "(w // 1000000)::double as window_start, w as window_us"


def query(**options) -> Query:
    return Query(START, END, **{"exact": True} | options)


def flat(df: DataFrame) -> DataFrame:
    """Values to six digits after the point, groups as text."""
    out = df.withColumn("value", F.round("value", 6))
    return out.withColumn("group", F.concat_ws("/", "group")) if "group" in df.columns else out


def over(x, span: tuple[float, float]):
    """A query or expression with its range, or those of all its leaves, replaced by span."""
    if isinstance(x, Query):
        return replace(x, start=span[0], end=span[1])
    if isinstance(x, Leaf):
        return replace(x, query=over(x.query, span))
    if isinstance(x, Arithmetic):
        return replace(x, left=over(x.left, span), right=over(x.right, span))
    return replace(x, arguments=tuple(over(a, span) for a in x.arguments)) if isinstance(x, Function) else x


def _on_events(kind: str, operation: str, window: float | None = None, percentile: float | None = None, **options) -> Callable[..., DataFrame]:
    empty = options.pop("include_empty_groups", False)
    return lambda s, d, span=(START, END): flat(aggregate(KINDS[kind](table(s, d, "events")), kind, operation, over(query(**options), span), window, percentile, empty))


def _composed(expression: Expression, window: float | None = None, output_filter: dict | None = None) -> Callable[..., DataFrame]:
    return lambda s, d, span=(START, END): flat(compose(over(expression, span), lambda metric, q, w: (metric, KINDS[metric](table(s, d, "events"))), window, output_filter))


def _many_values(s: SparkSession, d: str, span: tuple[float, float] = (START, END)) -> DataFrame:
    """Two values of the grouped key on each point."""
    points = event_gauge(table(s, d, "events"))
    user = F.substring_index(F.get("tags", F.lit(1)), ":", -1).cast("long")
    both = F.array(F.concat(F.lit("team:a"), (user % 3).cast("string")), F.concat(F.lit("team:b"), (user % 2).cast("string")))
    return flat(aggregate(points.withColumn("tags", both), "gauge", "average", over(query(group_by=("team",)), span)))


def _zero_denominators(s: SparkSession, d: str, span: tuple[float, float] = (START, END)) -> DataFrame:
    points = event_ratio(table(s, d, "events")).withColumn("den", F.col("seq") % 3)
    return flat(aggregate(points, "ratio", "average", over(query(), span)))


def _leaf(metric: str, operation: str, **options) -> Leaf:
    return Leaf(metric, operation, query(**options), 95 if operation == "percentile" else None)


def _functions(s: SparkSession, d: str) -> DataFrame:
    """All functions over signed values."""
    x = table(s, d, "events").select("event_id", (F.col("value") - 200).alias("x"))
    made = {f"f_{n.lower()}": F.round(call(n, *(F.col("x"), F.lit(2.0))[:k]), 6) + F.lit(0.0) for n, (k, _) in FUNCTIONS.items() if n not in ("Exponential", "Power")}
    made |= {"f_power": F.round(call("Power", F.abs("x"), F.lit(1.5)), 4), "f_exponential": F.round(call("Exponential", F.col("x") / 100), 6)}
    return x.select("event_id", *(c.alias(n) for n, c in made.items()))


def _division(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5 - 2.0).alias("a"), (F.col("event_id") % 4 - 1.0).alias("b"))
    return x.select("event_id", *((F.round(f(F.col("a"), F.col("b")), 6) + F.lit(0.0)).cast("string").alias(n.lower()) for n, f in ARITHMETIC.items() if n != "Divide"), (ARITHMETIC["Divide"](F.col("a"), F.col("b")) == float("inf")).alias("infinite"), F.isnan(ARITHMETIC["Divide"](F.col("a"), F.col("b"))).alias("undefined"))


def _logic(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    truth = lambda k: F.when(F.col("event_id") % k == 0, F.lit(None).cast("boolean")).otherwise(F.col("event_id") % k == 1)
    a, b = F.col("value"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.round("value"))
    made = {f"c_{op.lower()}": compare(op, a, b) for op in ("Equal", "NotEqual", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual")}
    return e.select("event_id", *(c.alias(n) for n, c in made.items()), both(truth(3), truth(5)).alias("l_and"), either(truth(3), truth(5)).alias("l_or"))


def _coalesced(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        points = KINDS[kind](table(s, d, "events")).withColumn("tags", F.slice("tags", 1, 1)).withColumn("primary_tag", F.lit("default"))
        made = coalesce_points(points, kind, NEAR, BLOCK)
        values = {"gauge": [F.col("value").cast("double").alias("value")], "count": ["count"], "ratio": ["num", "den"]}[kind]
        return made.select(F.get("tags", F.lit(0)).alias("tag"), "block_us", "t_us", "seq", *values)

    return run


def _coalesced_sql(values: str) -> str:
    return f"""with recursive p as (select event_id as seq, epoch_us(ts) as t, 'event_type:' || event_type as tag, value::float as v, (event_type = 'error')::bigint as num from events),
blocks(b) as (select min(t) from p union all select (select min(t) from p where t >= b + {BLOCK}) from blocks where exists (select 1 from p where t >= b + {BLOCK})),
q as (select p.*, b from p asof join blocks on p.t >= blocks.b),
anchors(tag, b, a) as (select tag, b, min(t) from q group by tag, b union all
  select tag, b, a from (select x.tag, x.b, (select min(t) from q where q.tag = x.tag and q.b = x.b and q.t >= x.a + {NEAR}) as a from anchors x) where a is not null),
m as (select q.*, a from q asof join anchors on q.tag = anchors.tag and q.b = anchors.b and q.t >= anchors.a)
select tag, b as block_us, a as t_us, min(seq) as seq, {values} from m group by tag, b, a"""


def _late(s: SparkSession, d: str) -> DataFrame:
    """Arrival is by a shuffle of the events within spans of four."""
    e = table(s, d, "events").withColumn("event_id", F.expr("(event_id div 4) * 4 + (3 * event_id + 1) % 4"))
    points = event_gauge(e).withColumn("primary_tag", primary_tag(F.col("tags"), keys=["event_type"]))
    return reject_late(points).groupBy("primary_tag").agg(F.count_if("late").alias("n_late"), F.count("*").alias("n"))


def _deltas(s: SparkSession, d: str) -> DataFrame:
    """The daily growth of each event type's running count as a share of all growth."""
    e = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("busy"), F.sum(F.lit(1) + (F.col("value") < 50).cast("int")).alias("total"))
    made = statistics.deltas(e, ["event_type"], "day", ["busy", "total"])
    return made.select("event_type", F.col("day").cast("string").alias("day"), "d_busy", "d_total", F.round(F.when(F.col("d_total") != 0, statistics.usage(F.col("d_busy"), F.col("d_total"))), 6).alias("usage"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    points = event_gauge(table(s, d, "events")).withColumn("tags", F.slice("tags", 1, 1)).withColumn("primary_tag", F.lit("default"))
    return statistics.storage_stats(coalesce_points(points, "gauge", NEAR, BLOCK))


def _rollup(s: SparkSession, d: str, span: tuple[float, float] = (START, END)) -> DataFrame:
    """Hourly averages of points stored by fifteen minutes, as a coarser granularity would give them."""
    points = event_gauge(table(s, d, "events")).withColumn("tags", F.slice("tags", 1, 1)).withColumn("primary_tag", F.lit("default"))
    return flat(aggregate(coalesce_points(points, "gauge", NEAR, BLOCK), "gauge", "average", over(query(), span), 3600.0))


def _lineitem(kind: str, operation: str, group_by: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    span = {"start": 694224000.0, "end": 915148800.0}
    adapter = lineitem_gauge if kind == "gauge" else lineitem_ratio
    return lambda s, d: flat(aggregate(adapter(table(s, d, "lineitem")), kind, operation, Query(**span, group_by=group_by)))


_IN = "l_shipdate >= timestamp '1992-01-01' and l_shipdate <= timestamp '1999-01-01'"
_VALUE = {"average": "avg(v)", "sum": "coalesce(sum(v), 0)", "max": "max(v)", "min": "min(v)", "percentile": "quantile_cont(v, 0.95)"}
_RATIO = {"average": "avg(num::double)", "sum": "sum(num) / sum(1)", "max": "max(num::double)", "min": "min(num::double)", "percentile": "quantile_cont(num::double, 0.95)"}


def _pairs() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
    for op, sql in _VALUE.items():
        p = 95 if op == "percentile" else None
        out[f"gauge_{op}"] = _on_events("gauge", op, percentile=p), f"{_P} select round({sql}, 6) as value from r"
        out[f"gauge_{op}_window"] = _on_events("gauge", op, DAY, p), f"{_P} select {_WINDOW}, round({sql}, 6) as value from w group by w"
        out[f"gauge_{op}_group_window"] = _on_events("gauge", op, DAY, p, group_by=BY_TYPE), f'{_P} select event_type as "group", {_WINDOW}, round({sql}, 6) as value from w group by w, event_type'
        out[f"ratio_{op}"] = _on_events("ratio", op, percentile=p), f"{_P} select round({_RATIO[op]}, 6) as value from r"
        out[f"ratio_{op}_window"] = _on_events("ratio", op, DAY, p), f"{_P} select {_WINDOW}, round({_RATIO[op]}, 6) as value from w group by w"
    out["gauge_percentile_approx"] = _on_events("gauge", "percentile", percentile=95, exact=False), None
    tag_sql = {"and": "event_type = 'click' and user_id = 3", "or": "event_type = 'click' or user_id = 3", "orand": "event_type in ('click', 'view') and user_id in (3, 4, 5)"}
    for name, spec in (("and", AND), ("or", OR), ("orand", OR_AND)):
        out[f"gauge_average_tags_{name}"] = _on_events("gauge", "average", tags_filter=spec), f"{_P} select round(avg(v), 6) as value from r where {tag_sql[name]}"
    out["gauge_average_input_filter"] = _on_events("gauge", "average", input_filter=ABOVE_100), f"{_P} select round(avg(v) filter (v > 100), 6) as value from r"
    out["gauge_average_input_transform"] = _on_events("gauge", "average", input_transform=SQRT), f"{_P} select round(avg(case when v >= 0 then sqrt(v) end), 6) as value from r"
    out["gauge_sum_filter_then_transform"] = _on_events("gauge", "sum", input_filter=ABOVE_100, input_transform=SQRT), f"{_P} select round(sum(sqrt(v)) filter (v > 100), 6) as value from r"
    out["gauge_sum_output_filter"] = _on_events("gauge", "sum", group_by=("user",), output_filter={"Compare": {"operation": "LessThan", "left": {"Value": "InputValue"}, "right": {"Value": {"Value": 5000.0}}}}), f'{_P} select user_id::varchar as "group", case when round(sum(v), 9) < 5000 then round(sum(v), 6) end as value from r group by user_id'
    out["gauge_sum_output_transform"] = _on_events("gauge", "sum", output_transform=SQRT), f"{_P} select round(sqrt(sum(v)), 6) as value from r"
    out["gauge_average_group"] = _on_events("gauge", "average", group_by=BY_TYPE), f'{_P} select event_type as "group", round(avg(v), 6) as value from r group by event_type'
    out["gauge_average_group_keys"] = _on_events("gauge", "average", group_by=("event_type", "user")), f"""{_P} select event_type || '/' || user_id as "group", round(avg(v), 6) as value from r group by event_type, user_id"""
    out["gauge_sum_empty_groups"] = _on_events("gauge", "sum", group_by=("event_type", "user"), include_empty_groups=True), f"""{_P}, u as (select distinct event_type from p), x as (select distinct user_id from p)
select u.event_type || '/' || x.user_id as "group", round(coalesce(sum(v), 0), 6) as value from u cross join x left join r on r.event_type = u.event_type and r.user_id = x.user_id group by u.event_type, x.user_id"""
    out["gauge_average_window_keep_empty"] = _on_events("gauge", "average", DAY, tags_filter=AND, remove_empty_datapoints=False), f"""{_P}, spine as (select {_S} + i * {_D} as w from range(0, ({_E} - {_S}) // {_D}) as x(i)), a as (select w, avg(v) as value from w where event_type = 'click' and user_id = 3 group by w)
select {_WINDOW.replace('w //', 'spine.w //').replace('w as', 'spine.w as')}, round(value, 6) as value from spine left join a on a.w = spine.w"""
    out["count_sum"] = _on_events("count", "sum"), f"{_P} select count(*)::double as value from r"
    out["count_rate"] = _on_events("count", "average"), f"{_P} select round(count(*) / {END - START}, 6) as value from r"
    out["count_sum_window"] = _on_events("count", "sum", DAY), f"{_P} select {_WINDOW}, count(*)::double as value from w group by w"
    out["count_rate_window"] = _on_events("count", "average", 3600.0), _P.replace(str(_D), str(3600 * SECOND)) + f" select {_WINDOW}, round(count(*) / 3600.0, 6) as value from w group by w"
    out["count_sum_group"] = _on_events("count", "sum", group_by=("user",)), f'{_P} select user_id::varchar as "group", count(*)::double as value from r group by user_id'
    out["ratio_average_group"] = _on_events("ratio", "average", group_by=("user",)), f'{_P} select user_id::varchar as "group", round(avg(num::double), 6) as value from r group by user_id'
    out["ratio_sum_window_denominator"] = _on_events("ratio", "sum", 3600.0, output_filter=MANY_DENOMINATORS), _P.replace(str(_D), str(3600 * SECOND)) + f" select {_WINDOW}, round(sum(num) / count(*), 6) as value from w group by w having count(*) > 3"
    gauge, by = _leaf("gauge", "average"), _leaf("gauge", "average", group_by=BY_TYPE)
    most, errors = _leaf("gauge", "max", group_by=BY_TYPE), _leaf("ratio", "sum", group_by=BY_TYPE)
    out["expr_scalar"] = _composed(Arithmetic("Multiply", Number(100), gauge)), f"{_P} select round(100 * avg(v), 6) as value from r"
    out["expr_two_metrics"] = _composed(Arithmetic("Divide", _leaf("gauge", "sum"), _leaf("count", "sum"))), f"{_P} select round(sum(v) / count(*), 6) as value from r"
    out["expr_group_scalar"] = _composed(Arithmetic("Subtract", by, gauge)), f'{_P} select event_type as "group", round(avg(v) - (select avg(v) from r), 6) as value from r group by event_type'
    out["expr_group_join"] = _composed(Arithmetic("Add", Arithmetic("Divide", by, most), errors)), f'{_P} select event_type as "group", round(avg(v) / max(v) + sum(num) / count(*), 6) as value from r group by event_type'
    out["expr_function_groups"] = _composed(Function("Max", (by, Arithmetic("Divide", most, Number(2))))), f'{_P} select event_type as "group", round(greatest(avg(v), max(v) / 2), 6) as value from r group by event_type'
    out["expr_windows"] = _composed(Arithmetic("Add", _leaf("gauge", "average"), Arithmetic("Multiply", _leaf("gauge", "max", tags_filter={"Or": ["event_type:click"]}), Number(0.5))), DAY), f"{_P} select {_WINDOW}, round(avg(v) + 0.5 * max(v) filter (event_type = 'click'), 6) as value from w group by w having count(*) filter (event_type = 'click') > 0"
    out["expr_group_windows"] = _composed(Arithmetic("Divide", _leaf("gauge", "sum", group_by=BY_TYPE), _leaf("count", "average", group_by=BY_TYPE)), DAY), f'{_P} select event_type as "group", {_WINDOW}, round(sum(v) / (count(*) / 86400.0), 6) as value from w group by w, event_type'
    low_by = _leaf("gauge", "min", group_by=BY_TYPE)
    out["expr_minimum"] = _composed(Arithmetic("Subtract", by, low_by)), f'{_P} select event_type as "group", round(avg(v) - min(v), 6) as value from r group by event_type'
    out["expr_percentile"] = _composed(Arithmetic("Divide", _leaf("gauge", "percentile", group_by=BY_TYPE), _leaf("gauge", "max"))), f'{_P} select event_type as "group", round(quantile_cont(v, 0.95) / (select max(v) from r), 6) as value from r group by event_type'
    out["expr_function_windows"] = _composed(Function("Max", (_leaf("gauge", "average"), Function("Sqrt", (_leaf("count", "sum"),)))), DAY), f"{_P} select {_WINDOW}, round(greatest(avg(v), sqrt(count(*))), 6) as value from w group by w"
    out["expr_output_filter"] = _composed(by, output_filter={"Compare": {"operation": "GreaterThan", "left": {"Value": "InputValue"}, "right": {"Value": {"Value": 50.0}}}}), f'{_P} select event_type as "group", round(avg(v), 6) as value from r group by event_type having avg(v) > 50'
    out["gauge_average_group_tags_or"] = _on_events("gauge", "average", group_by=BY_TYPE, tags_filter=OR), f"{_P} select event_type as \"group\", round(avg(v), 6) as value from r where {tag_sql['or']} group by event_type"
    out["gauge_average_group_tags_orand"] = _on_events("gauge", "average", group_by=BY_TYPE, tags_filter=OR_AND), f"{_P} select event_type as \"group\", round(avg(v), 6) as value from r where {tag_sql['orand']} group by event_type"
    out["gauge_sum_bare_filter"] = _on_events("gauge", "sum", input_filter={"Value": {"Value": 1.0}}), "select 0.0::double as value"
    out["gauge_average_window_fraction"] = _on_events("gauge", "average", 86_400.5), _P.replace(str(_D), str(86_400_500_000)) + f" select {_WINDOW}, round(avg(v), 6) as value from w group by w"
    out["gauge_average_group_values"] = _many_values, f"""{_P}, g as (select 'a' || user_id % 3 as g, v from r union all select 'b' || user_id % 2, v from r) select g as "group", round(avg(v), 6) as value from g group by g"""
    out["ratio_average_zero_denominators"] = _zero_denominators, f"{_P} select round(avg(num / (seq % 3)) filter (seq % 3 <> 0), 6) as value from r"
    out["functions"] = _functions, """select event_id, round(abs(x), 6) as f_abs, round(greatest(x, 2), 6) as f_max, round(least(x, 2), 6) as f_min, round(x) + 0 as f_round, ceil(x) + 0 as f_ceil, floor(x) + 0 as f_floor,
round(case when x >= 0 then sqrt(x) end, 6) as f_sqrt, round(x * x, 6) as f_square, round(pow(abs(x), 1.5), 4) as f_power, round(exp(x / 100), 6) as f_exponential, round(case when x > 0 then ln(x) end, 6) as f_loge,
round(case when x > 0 then ln(x) / ln(2) end, 6) as f_logbase, round(sin(x), 6) as f_sin, round(cos(x), 6) as f_cos, round(tan(x), 6) as f_tan from (select event_id, value - 200 as x from events)"""
    out["division"] = _division, """with x as (select event_id, case when event_id % 3 <> 0 then (event_id % 5 - 2)::double end as a, (event_id % 4 - 1)::double as b from events)
select event_id, round(a + b, 6)::varchar as add, round(a - b, 6)::varchar as subtract, (round(a * b, 6) + 0)::varchar as multiply, case when a is not null then b = 0 and a > 0 end as infinite, coalesce(a = 0 and b = 0, false) as undefined from x"""
    out["comparison_and_logic"] = _logic, """with x as (select event_id, value as a, case when event_id % 7 <> 0 then round(value) end as b, case when event_id % 3 <> 0 then event_id % 3 = 1 end as l, case when event_id % 5 <> 0 then event_id % 5 = 1 end as r from events)
select event_id, coalesce(a = b, false) as c_equal, coalesce(a <> b, true) as c_notequal, coalesce(a > b, false) as c_greaterthan, coalesce(a >= b, false) as c_greaterthanorequal, coalesce(a < b, false) as c_lessthan, coalesce(a <= b, false) as c_lessthanorequal,
case when l is null then null when not l then false else r end as l_and, case when l is null then null when l then true else r end as l_or from x"""
    out["coalesce_gauge"] = _coalesced("gauge"), _coalesced_sql("max_by(v, seq)::double as value")
    out["coalesce_count"] = _coalesced("count"), _coalesced_sql('count(*)::bigint as "count"')
    out["coalesce_ratio"] = _coalesced("ratio"), _coalesced_sql("sum(num)::bigint as num, count(*)::bigint as den")
    out["late_points"] = _late, """with p as (select 'event_type:' || event_type as primary_tag, (event_id // 4) * 4 + (3 * event_id + 1) % 4 as seq, epoch_us(ts) as t from events),
q as (select *, max(t) over (partition by primary_tag order by seq rows between unbounded preceding and 1 preceding) as newest from p)
select primary_tag, count(*) filter (t < newest) as n_late, count(*) as n from q group by primary_tag"""
    out["storage_stats"] = _stats, _coalesced_sql("0 as z").replace("select tag, b as block_us", "select 'default' as primary_tag, count(distinct block_us) as n_blocks, sum(k)::bigint as n_points, max(k) as max_sub_block from (select block_us, tag, count(*) as k from (select tag, b as block_us") + ") group by block_us, tag)"
    out["rollup_window"] = _rollup, _coalesced_sql("max_by(v, seq)::double as v").replace("select tag, b as block_us", f"select (w // 1000000)::double as window_start, w as window_us, round(avg(v), 6) as value from (select ((t_us - {_S}) // {3600 * SECOND}) * {3600 * SECOND} + {_S} as w, v from (select tag, b as block_us") + f") where t_us between {_S} and {_E - 1}) group by w"
    out["sample_deltas"] = _deltas, """with e as (select event_type, ts::date as day, count(*) as busy, sum(1 + (value < 50)::int)::bigint as total from events group by all),
x as (select event_type, day, busy - lag(busy) over w as d_busy, total - lag(total) over w as d_total from e window w as (partition by event_type order by day))
select event_type, day::varchar as day, d_busy, d_total, round(case when d_total <> 0 then 1 - d_busy / d_total end, 6) as usage from x"""
    out["range_stats"] = lambda s, d: statistics.range_stats(event_gauge(table(s, d, "events"))).select("n", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most")), f"{_P} select count(v) as n, min(v) as least, max(v) as most from p"
    out["retention"] = lambda s, d: statistics.retained(event_gauge(table(s, d, "events")), 5 * _D, _E).agg(F.count("*").alias("n"), F.min("t_us").alias("oldest")), f"{_P} select count(*) as n, min(t) as oldest from p where t >= {_E - 5 * _D}"
    out["histogram_percentile"] = lambda s, d: statistics.histogram_percentile(table(s, d, "events"), "value", 95, 0, 500, 50, ["event_type"]).withColumn("percentile", F.round("percentile", 6)), """with c as (select event_type, floor(value / 10) as bucket, count(*) as n from events where value >= 0 and value < 500 group by all),
r as (select *, sum(n) over (partition by event_type order by bucket) as upto, sum(n) over (partition by event_type) as total from c)
select event_type, round((bucket + (total * 0.95 - (upto - n)) / n) * 10, 6) as percentile from r where upto >= total * 0.95 and upto - n < total * 0.95"""
    out["primary_tags"] = lambda s, d: event_gauge(table(s, d, "events")).groupBy(primary_tag(F.col("tags"), ["user:3"]).alias("primary_tag")).agg(F.count("*").alias("n")), """select case when user_id = 3 then 'user:3' else 'default' end as primary_tag, count(*) as n from events group by all"""
    out["lineitem_price"] = _lineitem("gauge", "average", ("flag", "status")), f"""select l_returnflag || '/' || l_linestatus as "group", round(avg(l_extendedprice::float::double), 6) as value from lineitem where {_IN} group by l_returnflag, l_linestatus"""
    out["lineitem_returned"] = _lineitem("ratio", "sum", ("status",)), f"""select l_linestatus as "group", round(sum(case when l_returnflag = 'R' then l_quantity::bigint else 0 end) / sum(l_quantity::bigint), 6) as value from lineitem where {_IN} group by l_linestatus"""
    out |= {f"{name}_whole": _whole(*out[name]) for name in out if name.startswith(("gauge_", "ratio_", "count_", "expr_", "rollup_"))}
    out |= stored_queries.pairs()
    low, high, buckets = WHOLE_VALUES
    out["histogram_percentile_whole"] = lambda s, d: statistics.histogram_percentile(table(s, d, "events"), "value", 95, low, high, buckets, ["event_type"]).withColumn("percentile", F.round("percentile", 6)), out["histogram_percentile"][1].replace("value < 500", f"value < {high}")
    return out


def _whole(run: Callable[..., DataFrame], sql: str | None) -> tuple[Callable[[SparkSession, str], DataFrame], str | None]:
    """The same query and SQL over a range that holds the whole table; those over START..END show the range itself."""
    start, end = (round(x * SECOND) for x in WHOLE)
    spans = {_S: start, _E: end, _E - 1: end - 1, END - START: WHOLE[1] - WHOLE[0]}
    for old, new in spans.items():
        sql = sql and sql.replace(str(old), str(new))
    return lambda s, d: run(s, d, WHOLE), sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for n, (q, _) in _pairs().items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _pairs().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily averages of event values by type."""
    return queries()["gauge_average_group_window"](spark, sf_dir)
