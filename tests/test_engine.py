"""Number rules, coalescing against a plain fold, the stored catalog, requests and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tempograin.functions.numbers import both, call, compare, divide, either
from tempograin.functions.tags import checked, matches, primary_tag
from tempograin.operators.aggregates import NotSupported, Query, aggregate
from tempograin.operators.coalesce import coalesce_points, deal, reject_late
from tempograin.operators.statistics import histogram, merge_histograms, percentile_of, ratio_extremes
from tempograin.plans.compose import Arithmetic, Function, Leaf, Number, UnexpectedResult, compose
from tempograin.plans.requests import result_json
from tempograin.sources.adapters import json_points
from tempograin.sources.catalog import MetricAlreadyExists, MetricNotFound, MetricsEngine, WrongMetricType
from tempograin.streaming.ingest import dealt, merged

GAUGE = "tags array<string>, t_us bigint, seq bigint, value float"
NAN, INF = float("nan"), float("inf")


def test_number_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = lambda v: F.lit(v).cast("double")
    assert one(divide(lit(1), lit(0))) == INF and one(divide(lit(1), lit(-0.0))) == -INF and one(divide(lit(None), lit(0))) is None
    assert one(F.isnan(divide(lit(0), lit(0))))
    assert one(compare("NotEqual", lit(NAN), lit(NAN))) is True and one(compare("GreaterThan", lit(NAN), lit(1))) is False
    assert one(compare("LessThan", lit(1), lit(2))) is True and one(compare("Equal", lit(None), lit(2))) is None
    null, yes, no = F.lit(None).cast("boolean"), F.lit(True), F.lit(False)
    assert one(either(null, yes)) is None and one(both(no, null)) is False and one(both(yes, null)) is None
    assert one(call("Max", lit(NAN), lit(2))) == 2 and one(call("Sqrt", lit(-1))) is None and one(call("Abs", lit(1), lit(2))) is None
    assert one(call("LogBase", lit(8), lit(2))) == pytest.approx(3) and one(call("Ceil", lit(1e300))) == 1e300 and one(call("Round", lit(-0.5))) == -1


def test_tags(spark):
    df = spark.createDataFrame([(["a:1", "b:2"],), (["a:2", "a:1"],), ([],)], "tags array<string>")
    t = F.col("tags")
    specs = [None, {"And": ["a:1", "b:2"]}, {"Or": ["a:2", "b:2"]}, {"OrAnd": [["a:1"], ["b:2", "a:2"]]}]
    rows = df.select(*(matches(t, s).alias(str(i)) for i, s in enumerate(specs)), primary_tag(t, ["b:2"]).alias("p"), primary_tag(t, keys=["a"]).alias("k")).collect()
    assert list(map(tuple, rows)) == [(True, True, True, True, "b:2", "a:1"), (True, False, True, True, "default", "a:2"), (True, False, False, False, "default", "default")]
    with pytest.raises(ValueError):
        checked("no-colon")


def fold(points, near, block):
    """(block, anchor) of each time-ordered point of one primary tag."""
    start, anchors, out = None, {}, []
    for t, tag in points:
        if start is None or t - start >= block:
            start, anchors = t, {}
        if tag not in anchors or t - anchors[tag] >= near:
            anchors[tag] = t
        out.append((start, anchors[tag]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_coalescing_like_a_fold(spark, seed):
    rng = random.Random(seed)
    near, block = rng.choice(((5, 50), (1, 17), (30, 1000)))
    times = sorted(rng.randrange(-500, 20_000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(1500))
    points = [(t, f"k:{rng.randrange(3)}") for t in times]
    want = {}
    for seq, ((t, tag), (b, a)) in enumerate(zip(points, fold(points, near, block), strict=True)):
        want[tag, b, a] = seq
    df = spark.createDataFrame([([tag], t, i, float(i), "default") for i, (t, tag) in enumerate(points)], GAUGE + ", primary_tag string")
    made = {(r["tags"][0], r["block_us"], r["t_us"]): int(r["value"]) for r in coalesce_points(df, "gauge", near, block).collect()}
    assert made == want


def arrivals(points, near, block, kind):
    """(stored, late) of points (primary tag, time, tag, seq, value) one after another: {(primary tag, tag, block, anchor): value}, {seq}."""
    state, stored, late = {}, {}, set()
    for primary, t, tag, seq, value in points:
        start, end, anchors = state.get(primary, (None, None, {}))
        if start is not None and t < end:
            late.add(seq)
            continue
        if start is None or t - start >= block:
            start, end, anchors = t, t, {}
        if tag not in anchors or t - anchors[tag] >= near:
            anchors[tag] = t
            end = max(end, t)
        at = primary, tag, start, anchors[tag]
        stored[at] = value if kind == "gauge" else stored.get(at, 0) + value
        state[primary] = start, end, anchors
    return stored, late


@pytest.mark.parametrize("seed", range(6))
def test_arrivals_out_of_order_and_in_batches(spark, seed):
    rng = random.Random(seed)
    near, block, kind = *rng.choice(((20, 300), (90, 400), (3, 50))), ("gauge", "count")[seed % 2]
    rows, now = [], -400
    for i in range(1500):
        now += rng.choice((0, 1, 3, 9)) if rng.random() < 0.995 else rng.randrange(1000)
        back = rng.choice((1, 5, 30, 200)) if rng.random() < (0, 0.2)[seed > 1] else 0
        rows.append((f"p:{rng.randrange(2)}", now - back, f"k:{rng.randrange(3)}", i, rng.randrange(100)))
    want, late = arrivals(rows, near, block, kind)
    schema = "primary_tag string, t_us bigint, tags array<string>, seq bigint, " + {"gauge": "value float", "count": "count bigint"}[kind]
    found, rejected, opened = {}, set(), None
    bounds = [0, 1500] if seed == 2 else [0, 10, 700, 701, 1500]
    for a, b in zip(bounds, bounds[1:]):
        df = spark.createDataFrame([(p, t, [tag], seq, float(v) if kind == "gauge" else v) for p, t, tag, seq, v in rows[a:b]], schema)
        made = deal(df, kind, near, block, opened)
        made = spark.createDataFrame(made.collect(), made.schema)
        opened = made.filter("opened")
        for r in made.collect():
            if r["late"]:
                rejected.add(r["seq"])
            else:
                found[r["primary_tag"], r["tags"][0], r["block_us"], r["t_us"]] = r[{"gauge": "value", "count": "count"}[kind]]
    assert rejected == late
    assert found == want


def test_late_points(spark):
    rows = [(["a:1"], t, i, 0.0, p) for i, (t, p) in enumerate([(5, "x"), (3, "x"), (5, "x"), (1, "y"), (4, "x"), (9, "x")])]
    made = {r["seq"]: r["late"] for r in reject_late(spark.createDataFrame(rows, GAUGE + ", primary_tag string")).collect()}
    assert made == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False}


def test_empty_ranges_and_types(spark):
    df = spark.createDataFrame([(["a:1"], 10_000_000, 0, 1.5)], GAUGE)
    q = Query(100, 200)
    assert aggregate(df, "gauge", "sum", q).first()["value"] == 0 and aggregate(df, "gauge", "average", q).first()["value"] is None
    assert aggregate(df, "gauge", "sum", Query(0, 10)).first()["value"] == 1.5  # the end belongs to a range
    assert aggregate(df, "gauge", "sum", Query(0, 10), 5).count() == 0  # but to no whole window
    with pytest.raises(NotSupported):
        aggregate(df, "count", "max", q)
    with pytest.raises(NotSupported):
        aggregate(df, "ratio", "sum", Query(0, 1, input_transform="InputValue"))
    with pytest.raises(ValueError):
        Query(2, 1)


def test_composition_shapes(spark):
    df = spark.createDataFrame([([f"k:{i % 2}"], i * 1_000_000, i, float(i)) for i in range(10)], GAUGE)
    points = lambda metric, q, w: ("gauge", df)
    leaf = lambda op, *by: Leaf("m", op, Query(0, 10, group_by=by))
    rows = lambda e, w=None: sorted(map(tuple, compose(e, points, w).drop("window_us").collect()))
    assert rows(Arithmetic("Add", leaf("sum"), Number(1))) == [(46.0,)]
    assert rows(Arithmetic("Divide", leaf("sum", "k"), leaf("sum"))) == [(["0"], 20 / 45), (["1"], 25 / 45)]
    assert rows(Function("Max", (leaf("average", "k"), leaf("min", "k")))) == [(["0"], 4.0), (["1"], 5.0)]
    assert rows(Arithmetic("Subtract", leaf("max"), leaf("min")), 5) == [(0.0, 4.0), (5.0, 4.0)]
    assert rows(Function("Sqrt", (Arithmetic("Subtract", leaf("min"), leaf("max")),))) == [(None,)]
    with pytest.raises(UnexpectedResult):
        compose(Arithmetic("Add", leaf("sum", "k"), leaf("sum")), points, 5)
    with pytest.raises(UnexpectedResult):
        compose(Number(1), points)


def test_catalog(spark, tmp_path):
    engine = MetricsEngine(spark, str(tmp_path / "metrics"))
    engine.create_metric("cpu", "gauge", [(10.0, None), (1.0, None)])
    with pytest.raises(MetricAlreadyExists):
        engine.create_metric("cpu", "count")
    with pytest.raises(MetricNotFound):
        engine.ingest("memory", "gauge", None)
    engine.add_auto_primary_tag("cpu", "host")
    lines = [{"time": 1000 + i * 0.5, "value": i, "tags": [f"host:{i % 2}", "dc:x"]} for i in range(200)] + [{"time": 1.0, "value": 7, "tags": ["host:0"]}, {"time": 1200.0, "value": 7, "tags": ["bad"]}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    points = json_points(spark, str(tmp_path / "in.json"), "gauge")
    with pytest.raises(WrongMetricType):
        engine.ingest("cpu", "count", points)
    judged = engine.ingest("cpu", "gauge", points).groupBy("rejected").count().collect()
    assert {r["rejected"]: r["count"] for r in judged} == {None: 200, "InvalidTimeOrder": 1, "InvalidTag": 1}
    engine = MetricsEngine(spark, str(tmp_path / "metrics"))  # reload
    q = Query(1000, 1100, tags_filter={"And": ["host:1"]})
    assert engine.aggregate("cpu", "max", q).first()["value"] == 199
    assert engine.points("cpu", q)[1].count() == 10  # an anchor each ten seconds
    assert engine.points("cpu", Query(1001, 1098), 2.0)[1].filter("primary_tag = 'host:1'").count() > 90  # the finer granularity
    assert {r["primary_tag"]: r["n_points"] for r in engine.stats("cpu").collect()} == {"host:0": 10, "host:1": 10}
    late = engine.ingest("cpu", "gauge", points.filter("t_us < 1050000000")).filter("rejected is null").count()
    assert late == 0
    request = {"time_range": {"start": 1000, "end": 1100}, "expression": {"Arithmetic": {"operation": "Multiply", "left": {"Value": 2}, "right": {"Max": {"metric": "cpu", "query": {"group_by": "host"}}}}}}
    assert [r["json"] for r in result_json(engine.request(json.dumps(request))).collect()] == ['["0",396.0]', '["1",398.0]']
    windows = engine.request(request | {"duration": 50, "expression": {"Sum": {"metric": "cpu"}}})
    assert len(json.loads(result_json(windows).first()["json"])) == 2


def test_batches_are_one_batch(spark, tmp_path):
    rng = random.Random(9)
    rows, now = [], 0
    for i in range(900):
        now += rng.randrange(400_000)
        rows.append(([f"host:{rng.randrange(2)}", f"core:{rng.randrange(2)}"], now - rng.choice((0, 0, 0, 250_000, 9_000_000)), i, i + 1))
    schema = "tags array<string>, t_us bigint, seq bigint, count bigint"
    points = lambda a, b: spark.createDataFrame(rows[a:b], schema)
    engine = MetricsEngine(spark, str(tmp_path / "m"))
    seen, late = {}, {}
    for name, bounds in (("once", [0, 900]), ("often", [0, 1, 200, 210, 600, 900])):
        engine.create_metric(name, "count", [(2.0, 60.0), (0.5, None)], block=20.0)
        engine.add_auto_primary_tag(name, "host")
        late[name] = sorted(r["seq"] for a, b in zip(bounds, bounds[1:]) for r in engine.ingest(name, "count", points(a, b)).filter("rejected = 'InvalidTimeOrder'").collect())
        metric, batches = engine.metric(name), engine._batches(name)
        seen[name] = [sorted((r["primary_tag"], tuple(sorted(r["tags"])), r["block_us"], r["t_us"], r["count"]) for r in engine._stored(metric, step, batches).collect()) for step in metric.granularities]
    assert seen["once"] == seen["often"] and late["once"] == late["often"] and late["once"]
    want, lost = arrivals([(t[0], u, "/".join(t), seq, v) for t, u, seq, v in rows], 2_000_000, 20_000_000, "count")
    assert {(p, "/".join(sorted(t, reverse=True)), b, a): v for p, t, b, a, v in seen["once"][0]} == want
    assert lost <= set(late["once"])  # finer steps reject more
    # an unfinished batch isn't there
    metric, total = engine.metric("often"), Query(0, 1e6)
    before = engine.aggregate("often", "sum", total).first()["value"]
    engine._write(metric, metric.granularities[0], "unfinished", points(0, 5).withColumns({"primary_tag": F.lit("host:0"), "block_us": F.lit(0), "role": F.lit("stored")}))
    assert engine.aggregate("often", "sum", total).first()["value"] == before
    # expiry
    engine.compact("often")
    newest = max(r[3] for r in seen["often"][0])
    left = engine._stored(metric, metric.granularities[0], engine._batches("often"))
    assert left.filter("role = 'stored'").agg(F.min("t_us")).first()[0] >= newest - 60_000_000
    assert engine.aggregate("often", "sum", total).first()["value"] == before
    assert len(list((tmp_path / "m/metrics/often/2000000").iterdir())) == 2  # the new one and the unfinished one
    engine.ingest("often", "count", spark.createDataFrame([(["host:0", "core:0"], newest + 1, 0, 5)], schema))
    assert engine.aggregate("often", "sum", total).first()["value"] == before + 5
    for bad in ("a/b", "..", "", "_x"):
        with pytest.raises(ValueError):
            engine.create_metric(bad, "gauge")


def test_leaves_with_other_tag_filters(spark, tmp_path):
    engine = MetricsEngine(spark, str(tmp_path / "m"))
    engine.create_metric("v", "gauge")
    engine.add_auto_primary_tag("v", "host")
    engine.ingest("v", "gauge", spark.createDataFrame([([f"host:{i % 2}"], i * 1_000_000, i, float(i % 3 + 1)) for i in range(20)], GAUGE))
    leaf = lambda *tags: Leaf("v", "sum", Query(0, 100, tags_filter={"And": list(tags)} if tags else None))
    sums = [sum(i % 3 + 1 for i in range(20) if i % 2 == h) for h in (0, 1)]
    one = lambda e, **o: engine.compose(e, **o).first()["value"]
    assert one(Arithmetic("Add", leaf("host:0"), leaf("host:1"))) == sum(sums)
    assert one(Arithmetic("Divide", leaf("host:0"), leaf())) == sums[0] / sum(sums)
    over = {"Compare": {"operation": "GreaterThan", "left": {"Value": "InputValue"}, "right": {"Value": {"Value": float(sum(sums))}}}}
    assert one(leaf(), output_filter=over) is None
    assert engine.points("v", leaf("host:0").query)[1].filter("primary_tag = 'host:1'").count() == 0


def test_histograms(spark):
    rows = [(k, float(i)) for k in "ab" for i in range(1, 1001)] + [("c", 5.0)]
    made = histogram(spark.createDataFrame(rows, "k string, v double"), "v", ["k"])
    found = {r["k"]: r["percentile"] for r in percentile_of(made, 99, ["k"]).collect()}
    assert found["a"] == found["b"] == pytest.approx(990, abs=1) and found["c"] == 5.0
    assert {r["buckets"] for r in made.filter("k = 'a'").collect()} == {32}
    whole = merge_histograms(made.filter("k <> 'c'").drop("k"))
    assert whole.agg(F.sum("n")).first()[0] == 2000 and whole.first()["buckets"] == 45
    assert percentile_of(whole, 50).first()["percentile"] == pytest.approx(500, abs=25)
    pairs = spark.createDataFrame([(1, 2, 0, 0), (3, 4, 1, 1), (6, 8, 2, 2), (9, 0, 3, 3), (1, 2, 4, 4)], "num bigint, den bigint, t_us bigint, seq bigint")
    r = ratio_extremes(pairs).first()
    assert tuple(r["least"]) == (1, 2) and tuple(r["most"]) == (3, 4)


def test_stream_deals_as_the_batch_does(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.randrange(10_000) for _ in range(600))
    df = spark.createDataFrame([([f"k:{rng.randrange(2)}"], t, i, float(i), f"p:{i % 3}") for i, t in enumerate(times)], GAUGE + ", primary_tag string")
    for part in range(3):
        df.filter(f"seq div 200 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    sink = dealt(stream, "gauge", 40, 900).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    sink.awaitTermination(300)
    rows = lambda d: sorted(map(tuple, d.select("primary_tag", "tags", "block_us", "t_us", "seq", "value").collect()))
    assert rows(merged(spark.read.parquet(f"{tmp_path}/out"), "gauge")) == rows(coalesce_points(df, "gauge", 40, 900))
