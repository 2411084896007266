"""Registered queries that go through the catalog or a stream, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tags import primary_tag
from .operators import statistics
from .operators.aggregates import Query
from .operators.coalesce import coalesce_points, deal
from .operators.points import SECOND, micros, validated
from .plans.compose import Arithmetic, Function, Leaf
from .plans.requests import result_json
from .sources import adapters
from .sources.adapters import event_count, event_gauge, event_ratio, json_points, table
from .sources.catalog import MetricsEngine
from .sources.scratch import scratch
from .streaming.ingest import dealt, merged, windowed

#: Coalescing over events, which come every few minutes.
NEAR, BLOCK = 900, 6 * 3600
START, END = 1704067200.0, 1735689600.0
KINDS = {"gauge": event_gauge, "count": event_count, "ratio": event_ratio}
BATCHES = 3
#: Rows of a micro-batch, about, and partitions of a stream's state.
STREAM_ROWS, STATE_PARTITIONS = 1_000_000, 12
Pair = tuple[Callable[[SparkSession, str], DataFrame], str]


_folders: dict[tuple, str] = {}


def _engine(s: SparkSession, d: str, *kinds: str, near: float = NEAR, keep: float | None = None) -> MetricsEngine:
    """A catalog with a metric of each kind, under the kind's name and with a partition for each event type; events come in three batches.

    Queries of one application share a catalog that no query changes. It is opened again before use.
    """
    key = (s.sparkContext.applicationId, d, near, keep)
    folder = _folders[key] = scratch(s, "catalog") if keep or key not in _folders else _folders[key]
    engine, events = MetricsEngine(s, folder), table(s, d, "events")
    if new := sorted(set(kinds) - set(engine.metrics())):
        top = events.agg(F.max("event_id")).first()[0] or 0
        bounds = [-(-i * (top + 1) // BATCHES) for i in range(BATCHES + 1)]
        for kind in new:
            engine.create_metric(kind, kind, [(near, keep)], block=BLOCK)
            engine.add_auto_primary_tag(kind, "event_type")

        def fill(kind: str) -> None:
            for low, high in zip(bounds, bounds[1:]):  # a range of the column itself reaches the scan
                engine.ingest(kind, kind, KINDS[kind](events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))))

        # metrics have nothing in common, and the last groups of one batch leave cores idle
        with ThreadPoolExecutor(len(new)) as pool:
            list(pool.map(inheritable_thread_target(s)(fill), new))
    return MetricsEngine(s, folder)


def _flat(df: DataFrame) -> DataFrame:
    out = df.withColumn("value", F.round("value", 6))
    return out.withColumn("group", F.concat_ws("/", "group")) if "group" in df.columns else out


def chain_sql(primary: str, tag: str, near: float, block: float, source: str = "events") -> str:
    """Tables up to m: each event with its primary tag, tag, block b and anchor a, if all arrive in order."""
    n, b = round(near * SECOND), round(block * SECOND)
    return f"""with recursive p as (select event_id as seq, epoch_us(ts) as t, {primary} as prim, {tag} as tag, value::float as v, (event_type = 'error')::bigint as num, event_type, user_id from {source}),
blocks(prim, b) as (select prim, min(t) from p group by prim union all
  select prim, nb from (select x.prim, (select min(t) from p where p.prim = x.prim and p.t >= x.b + {b}) as nb from blocks x) where nb is not null),
q as (select p.*, b from p asof join blocks on p.prim = blocks.prim and p.t >= blocks.b),
anchors(prim, tag, b, a) as (select prim, tag, b, min(t) from q group by prim, tag, b union all
  select prim, tag, b, a from (select x.prim, x.tag, x.b, (select min(t) from q where q.prim = x.prim and q.tag = x.tag and q.b = x.b and q.t >= x.a + {n}) as a from anchors x) where a is not null),
m as (select q.*, a from q asof join anchors on q.prim = anchors.prim and q.tag = anchors.tag and q.b = anchors.b and q.t >= anchors.a),
st as (select prim, tag, b, a, min(seq) as seq, max_by(v, seq)::double as v, sum(num)::bigint as num, count(*)::bigint as n, any_value(event_type) as event_type, any_value(user_id) as user_id from m group by prim, tag, b, a) """


_PRIM, _TAG = "'event_type:' || event_type", "event_type || '/' || user_id"
_VALUES = {"gauge": ("value", "v as value"), "count": ("count", "n as \"count\""), "ratio": ("num,den", "num, n as den")}


def _rows(df: DataFrame, kind: str) -> DataFrame:
    values = [F.col(v).cast("double").alias(v) if v == "value" else F.col(v) for v in _VALUES[kind][0].split(",")]
    return df.select("primary_tag", F.concat_ws("/", F.transform("tags", lambda t: F.substring_index(t, ":", -1))).alias("tag"), "block_us", "t_us", "seq", *values)


def _coalesced(kind: str) -> Pair:
    """Real sets of tags and a primary tag for each event type, in one batch."""

    def run(s: SparkSession, d: str) -> DataFrame:
        points = KINDS[kind](table(s, d, "events"))
        return _rows(coalesce_points(points.withColumn("primary_tag", primary_tag(F.col("tags"), keys=["event_type"])), kind, NEAR * SECOND * 40, BLOCK * SECOND * 8), kind)

    return run, chain_sql(_PRIM, _TAG, NEAR * 40, BLOCK * 8) + f"select prim as primary_tag, tag, b as block_us, a as t_us, seq, {_VALUES[kind][1]} from st"


def _stored(kind: str) -> Pair:
    """What three batches left in the catalog."""

    def run(s: SparkSession, d: str) -> DataFrame:
        engine = _engine(s, d, kind, near=NEAR * 8)
        return _rows(engine.points(kind, Query(START, END))[1], kind)

    return run, chain_sql(_PRIM, _TAG, NEAR * 8, BLOCK) + f"select prim as primary_tag, tag, b as block_us, a as t_us, seq, {_VALUES[kind][1]} from st"


_STORED_SQL = chain_sql(_PRIM, _TAG, NEAR, BLOCK)


def _late(s: SparkSession, d: str) -> DataFrame:
    """Arrival is by a shuffle of the events within spans of four; two sets of tags for each event type."""
    e = table(s, d, "events").withColumn("event_id", F.expr("(event_id div 4) * 4 + (3 * event_id + 1) % 4"))
    odd = F.array(F.concat(F.lit("event_type:"), "event_type"), F.concat(F.lit("odd:"), (F.col("user_id") % 2).cast("string")))
    points = e.select(F.concat(F.lit("event_type:"), "event_type").alias("primary_tag"), odd.alias("tags"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("t_us"), F.col("event_id").alias("seq"), F.col("value").cast("float").alias("value"))
    made = deal(points, "gauge", 1_800 * SECOND, BLOCK * SECOND)
    return made.select("primary_tag", F.get("tags", F.lit(1)).alias("tag"), F.when(~F.col("late"), F.col("block_us")).alias("block_us"), "t_us", "seq", F.col("value").cast("double").alias("value"), "late")


_LATE_SQL = f"""with recursive p as (select 'event_type:' || event_type as prim, 'odd:' || (user_id % 2) as tag, (event_id // 4) * 4 + (3 * event_id + 1) % 4 as seq, epoch_us(ts) as t, value::float::double as v from events),
n as (select *, row_number() over (partition by prim order by seq) as i from p),
r(prim, i, tag, seq, t, v, s, a0, a1, own, late) as (
  select prim, i, tag, seq, t, v, t, case when tag = 'odd:0' then t end, case when tag = 'odd:1' then t end, t, false from n where i = 1
  union all
  select prim, i, tag, seq, t, v, s, case when k = 0 or tag = 'odd:1' then o0 else own end, case when k = 0 or tag = 'odd:0' then o1 else own end, own, k = 0 from (
    select *, case when k = 0 then t when (case when tag = 'odd:0' then o0 else o1 end) is null or t - (case when tag = 'odd:0' then o0 else o1 end) >= {1_800 * SECOND} then t else (case when tag = 'odd:0' then o0 else o1 end) end as own from (
      select n.prim, n.i, n.tag, n.seq, n.t, n.v, case when n.t >= r.s + {BLOCK * SECOND} then n.t else r.s end as s,
        case when n.t >= r.s + {BLOCK * SECOND} then null else r.a0 end as o0, case when n.t >= r.s + {BLOCK * SECOND} then null else r.a1 end as o1,
        case when n.t < greatest(coalesce(r.a0, r.a1), coalesce(r.a1, r.a0)) then 0 else 1 end as k
      from r join n on n.prim = r.prim and n.i = r.i + 1)))
select prim as primary_tag, tag, s as block_us, own as t_us, min(seq) as seq, max_by(v, seq) as value, false as late from r where not late group by prim, tag, s, own
union all select prim, tag, null, t, seq, v, true from r where late"""


def _json(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, read again as gauge points."""
    path, e = scratch(s, "lines"), table(s, d, "events")
    tags = F.array(F.concat(F.lit("event_type:"), "event_type"), F.concat(F.lit("user:"), "user_id"))
    e.select((F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)") / SECOND).alias("time"), "value", tags.alias("tags")).write.json(path)
    return json_points(s, path, "gauge").select("t_us", F.concat_ws(",", "tags").alias("tags"), F.col("value").cast("double").alias("value"))


def _arrive(points: DataFrame, path: str) -> None:
    """points as files under path/in of about STREAM_ROWS rows, BATCHES at least, written one after another in order of seq, as a stream takes them by age."""
    spark, n = points.sparkSession, max(BATCHES, -(-points.count() // STREAM_ROWS))
    points.limit(0).coalesce(1).write.parquet(f"{path}/in")
    points.repartitionByRange(n, "seq").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/parts")
    parts = spark.read.schema("seq bigint, part int").parquet(f"{path}/parts")
    for row in parts.select("part").distinct().orderBy("part").collect():
        spark.read.schema(points.schema).parquet(f"{path}/parts/part={row['part']}").coalesce(1).write.mode("append").parquet(f"{path}/in")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files, dealt with state, then merged.

    A micro-batch is a file, so what a task holds doesn't grow with the table. A batch's time goes mostly into the files of
    its state, one for each partition and batch; the few primary tags don't need more than STATE_PARTITIONS.
    """
    path = scratch(s, "stream")
    points = event_gauge(table(s, d, "events")).drop("ts").withColumn("primary_tag", primary_tag(F.col("tags"), keys=["event_type"]))
    _arrive(points, path)
    own = s.newSession()
    own.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    read = own.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    made = dealt(read, "gauge", NEAR * 8 * SECOND, BLOCK * SECOND)
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return _rows(merged(s.read.schema(made.schema).parquet(f"{path}/out"), "gauge"), "gauge")


def _stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Daily counts and sums of a stream of events, by event time with a watermark."""
    path = scratch(s, "windows")
    table(s, d, "events").coalesce(1).write.parquet(f"{path}/in")
    read = s.readStream.schema(table(s, d, "events").schema).parquet(f"{path}/in")
    timed = read.select(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("event_time"), "value").withWatermark("event_time", "1 day")
    name = f"w{path[-8:]}"
    windowed(timed, 86_400 * SECOND).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start().awaitTermination()
    return s.table(name).select("n", F.round("sum", 4).alias("sum"))


def _request(s: SparkSession, d: str) -> DataFrame:
    body = {"time_range": {"start": START, "end": END}, "expression": {"Arithmetic": {"operation": "Multiply", "left": {"Value": 2}, "right": {"Sum": {"metric": "count", "query": {"group_by": "event_type", "tags_filter": {"Or": ["event_type:click", "event_type:view", "user:3"]}}}}}}}
    return result_json(_engine(s, d, "count").request(body))


def _leaf(metric: str, operation: str, *tags: str, **options) -> Leaf:
    percentile = options.pop("percentile", None)
    return Leaf(metric, operation, Query(START, END, tags_filter={"And": list(tags)} if tags else None, exact=True, **options), percentile)


def _two_filters(s: SparkSession, d: str) -> DataFrame:
    return _flat(_engine(s, d, "gauge").compose(Arithmetic("Divide", _leaf("gauge", "sum", "event_type:click"), Arithmetic("Add", _leaf("gauge", "sum", "event_type:view"), _leaf("gauge", "sum")))))


def _two_metrics(window: float | None) -> Callable[[SparkSession, str], DataFrame]:
    by = {"group_by": ("event_type",)} if window is None else {}
    expression = Function("Max", (_leaf("gauge", "average", **by), Arithmetic("Add", _leaf("count", "sum", **by), _leaf("ratio", "sum", **by))))
    return lambda s, d: _flat(_engine(s, d, "gauge", "count", "ratio").compose(expression, window))


def _retained(s: SparkSession, d: str) -> DataFrame:
    """A metric that keeps five days, before and after what is older was deleted."""
    engine, values = _engine(s, d, "count", keep=5 * 86_400.0), []
    for _ in range(2):
        values.append((engine.aggregate("count", "sum", Query(START, END)).first()["value"],))
        engine.compact("count")
    return s.createDataFrame(values, "value double")


def pairs() -> dict[str, Pair]:
    day = 86_400 * SECOND
    window = f"({round(START * SECOND)} + ((a - {round(START * SECOND)}) // {day}) * {day})"
    out: dict[str, Pair] = {}
    for kind in KINDS:
        out[f"coalesce_{kind}_tags"] = _coalesced(kind)
        out[f"catalog_{kind}"] = _stored(kind)
    out["ingest_late"] = _late, _LATE_SQL
    out["catalog_stats"] = lambda s, d: _engine(s, d, "gauge").stats("gauge"), _STORED_SQL + "select prim as primary_tag, count(distinct b) as n_blocks, sum(k)::bigint as n_points, max(k) as max_sub_block from (select prim, b, tag, count(*) as k from st group by prim, b, tag) group by prim"
    out["catalog_request"] = _request, _STORED_SQL + """select '["' || event_type || '",' || (2 * sum(n))::double || ']' as json from st where event_type in ('click', 'view') or user_id = 3 group by event_type"""
    out["catalog_two_filters"] = _two_filters, _STORED_SQL + "select round(sum(v) filter (event_type = 'click') / (sum(v) filter (event_type = 'view') + sum(v)), 6) as value from st"
    out["catalog_group_join"] = _two_metrics(None), _STORED_SQL + """select event_type as "group", round(greatest(avg(v), sum(n) + sum(num) / sum(n)), 6) as value from st group by event_type"""
    out["catalog_window_join"] = _two_metrics(86_400.0), _STORED_SQL + f"select ({window} // 1000000)::double as window_start, {window} as window_us, round(greatest(avg(v), sum(n) + sum(num) / sum(n)), 6) as value from st group by {window}"
    out["catalog_retention"] = _retained, _STORED_SQL + ", k as (select sum(n)::double as value from st where a >= (select max(a) from st) - 5 * 86400000000) select value from k union all select value from k"
    out["json_points"] = _json, "select epoch_us(ts) as t_us, 'event_type:' || event_type || ',user:' || user_id as tags, value::float::double as value from events"
    out["stream_gauge"] = _stream, chain_sql(_PRIM, _TAG, NEAR * 8, BLOCK) + "select prim as primary_tag, tag, b as block_us, a as t_us, seq, v as value from st"
    out["stream_windows"] = _stream_windows, "select count(*) as n, round(sum(value), 4) as \"sum\" from events group by ts::date"
    out["limit_of_counts"] = (
        lambda s, d: validated(event_count(table(s, d, "events")).withColumn("count", (F.col("seq") * 10_007 - 5).cast("long")), "count").groupBy("rejected").agg(F.count("*").alias("n")),
        "select case when event_id * 10007 - 5 < 0 or event_id * 10007 - 5 >= 16777216 then 'TooLargeCount' end as rejected, count(*) as n from events group by 1",
    )
    out["quantised_times"] = lambda s, d: table(s, d, "events").select("event_id", micros(F.col("value") / 7).alias("t_us")), "select event_id, round(value / 7 * 1000000)::bigint as t_us from events"
    out["auto_histogram"] = (
        lambda s, d: statistics.histogram(table(s, d, "events"), "value", ["event_type"]).select("event_type", "bucket", "n"),
        """with x as (select event_type, min(value) as lo, max(value) as hi, ceil(sqrt(count(*))) as k from events group by event_type)
select event_type, least(floor((value - lo) / (hi - lo) * k), k - 1)::bigint as bucket, count(*)::bigint as n from events join x using (event_type) group by 1, 2""",
    )
    out["merged_histogram"] = (
        lambda s, d: statistics.merge_histograms(statistics.histogram(table(s, d, "events"), "value", ["event_type"])).select("bucket", "n"),
        """with x as (select event_type, min(value) as lo, max(value) as hi, ceil(sqrt(count(*))) as k from events group by event_type),
h as (select event_type, lo, hi, k, least(floor((value - lo) / (hi - lo) * k), k - 1) as bucket, count(*) as n from events join x using (event_type) group by all),
y as (select min(lo) as lo, max(hi) as hi, ceil(sqrt(sum(n))) as k from h)
select least(floor((h.lo + (bucket + 0.5) / h.k * (h.hi - h.lo) - y.lo) / (y.hi - y.lo) * y.k), y.k - 1)::bigint as bucket, sum(n)::bigint as n from h, y group by 1""",
    )
    out["extreme_ratios"] = (
        lambda s, d: statistics.ratio_extremes(adapters.lineitem_ratio(table(s, d, "lineitem")).withColumns({"num": F.col("seq") % 97, "den": F.col("seq") % 13}), []).select("least.num", "least.den", F.col("most.num").alias("most_num"), F.col("most.den").alias("most_den")),
        """with x as (select (l_orderkey * 8 + l_linenumber) % 97 as num, (l_orderkey * 8 + l_linenumber) % 13 as den, l_shipdate as t, l_orderkey * 8 + l_linenumber as seq from lineitem),
y as (select *, row_number() over (order by num / den, t, seq) as a, row_number() over (order by -num / den, t, seq) as b from x where den <> 0)
select max(num) filter (a = 1) as num, max(den) filter (a = 1) as den, max(num) filter (b = 1) as most_num, max(den) filter (b = 1) as most_den from y""",
    )
    return out
