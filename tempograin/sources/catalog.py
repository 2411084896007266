"""Metrics by name, stored as Parquet under one folder that Spark can reach.

folder/catalog holds a row for each declaration, appended. A metric's batches are under folder/metrics/<name>: points of each
granularity by batch, role, partition and day, and one row of commits for each batch, which is written last. What has no such
row doesn't exist for readers, so a batch is there at all granularities or at none. Roles: stored points; open ones, which
the next batch may still merge into and writes again (of these only the latest batch's count); late ones, for the report.
A partition is a point's only primary tag, "default" without one, "mixed" with several. One writer for each metric at a time.
"""

from __future__ import annotations

import dataclasses
import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import DEFAULT, checked, possible_partitions, primary_tag
from ..operators.aggregates import Query, aggregate
from ..operators.coalesce import TYPES, deal
from ..operators.points import SECOND, VALUES, validated
from ..operators.statistics import storage_stats
from ..plans.compose import Expression, compose
from ..plans.requests import request_of

DAY = 86_400 * SECOND
MIXED = "mixed"
BLOCK = 600.0
#: Seconds within which points are stored as one.
DATAPOINT = {"gauge": 0.2, "count": 1.0, "ratio": 1.0}
_CATALOG = "name string, kind string, what string, text string, datapoint_us bigint, block_us bigint, keep_us bigint"
_COMMITS = "n bigint, batch string, whole boolean, steps array<struct<datapoint_us:bigint,low:bigint,high:bigint,n_late:bigint>>"


class MetricNotFound(KeyError):
    pass


class MetricAlreadyExists(ValueError):
    pass


class WrongMetricType(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class Granularity:
    """keep_us: how far back from the newest point queries see; None for all."""

    datapoint_us: int
    block_us: int
    keep_us: int | None = None


@dataclasses.dataclass(frozen=True)
class Metric:
    name: str
    kind: str
    granularities: tuple[Granularity, ...]  # the coarsest first
    primary_tags: tuple[str, ...] = ()
    primary_keys: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class Batch:
    """A committed batch: its least and newest time by granularity, None without points. whole: it takes the place of all before it."""

    n: int
    name: str
    whole: bool
    spans: dict[int, tuple[int | None, int | None]]
    n_late: dict[int, int]


def _partition(metric: Metric) -> Column:
    eligible = F.filter("tags", lambda t: t.isin(list(metric.primary_tags)) | F.substring_index(t, ":", 1).isin(list(metric.primary_keys)))
    return F.when(F.size(eligible) > 1, MIXED).otherwise(F.col("primary_tag"))


def _span(batches: Sequence[Batch], step: Granularity) -> tuple[int | None, int | None]:
    known = [b.spans[step.datapoint_us] for b in batches if b.spans[step.datapoint_us][0] is not None]
    return (min(low for low, _ in known), max(high for _, high in known)) if known else (None, None)


class MetricsEngine:
    """All metrics of a folder; a folder that was filled before is read as it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self, schema: str, path: str) -> list:
        try:
            return self.spark.read.schema(schema).parquet(path).collect()
        except AnalysisException:  # nothing was written yet
            return []

    def _declare(self, **row) -> None:
        whole = {k: None for k in ("name", "kind", "what", "text", "datapoint_us", "block_us", "keep_us")} | row
        self.spark.createDataFrame([tuple(whole.values())], _CATALOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/catalog")

    def metrics(self) -> dict[str, Metric]:
        """Declared metrics; there are as many as someone named, so the driver can hold them."""
        rows, out = self._rows(_CATALOG, f"{self.folder}/catalog"), {}
        for r in (r for r in rows if r["what"] == "metric"):
            own = [x for x in rows if x["name"] == r["name"]]
            steps = tuple(sorted((Granularity(x["datapoint_us"], x["block_us"], x["keep_us"]) for x in own if x["what"] == "granularity"), key=lambda g: -g.datapoint_us))
            out[r["name"]] = Metric(r["name"], r["kind"], steps, *(tuple(sorted(x["text"] for x in own if x["what"] == what)) for what in ("primary tag", "primary key")))
        return out

    def metric(self, name: str, kind: str | None = None) -> Metric:
        known = self.metrics()
        if name not in known:
            raise MetricNotFound(name)
        if kind is not None and known[name].kind != kind:
            raise WrongMetricType(f"{name} is a {known[name].kind}")
        return known[name]

    def create_metric(self, name: str, kind: str, granularities: Sequence[tuple[float, float | None]] = (), block: float = BLOCK) -> None:
        """granularities: (seconds within which points are stored as one, seconds to keep)."""
        if kind not in VALUES:
            raise ValueError(f"unknown kind {kind}")
        if not re.fullmatch(r"[^/\\:*?\"<>|\x00-\x1f._][^/\\:*?\"<>|\x00-\x1f]*", name):
            raise ValueError(f"{name!r} can't be the name of a folder")
        if name in self.metrics():
            raise MetricAlreadyExists(name)
        for datapoint, keep in granularities or [(DATAPOINT[kind], None)]:
            self._declare(name=name, what="granularity", datapoint_us=round(datapoint * SECOND), block_us=round(block * SECOND), keep_us=None if keep is None else round(keep * SECOND))
        self._declare(name=name, kind=kind, what="metric")

    def add_primary_tag(self, name: str, tag: str) -> None:
        self._declare(name=self.metric(name).name, what="primary tag", text=checked(tag))

    def add_auto_primary_tag(self, name: str, key: str) -> None:
        """Every value of the key is a primary tag."""
        self._declare(name=self.metric(name).name, what="primary key", text=key)

    def _home(self, name: str) -> str:
        return f"{self.folder}/metrics/{name}"

    def _batches(self, name: str) -> list[Batch]:
        """Committed batches that count, in order; a row for each, so the driver can hold them (compact() makes them one)."""
        rows = sorted(self._rows(_COMMITS, f"{self._home(name)}/commits"), key=lambda r: r["n"])
        made = [Batch(r["n"], r["batch"], r["whole"], {s["datapoint_us"]: (s["low"], s["high"]) for s in r["steps"]}, {s["datapoint_us"]: s["n_late"] for s in r["steps"]}) for r in rows]
        return made[max((i for i, b in enumerate(made) if b.whole), default=0) :]

    def _commit(self, name: str, batches: Sequence[Batch], batch: str, whole: bool, steps: list[tuple]) -> None:
        row = (batches[-1].n + 1 if batches else 0, batch, whole, steps)
        self.spark.createDataFrame([row], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self._home(name)}/commits")

    def _files(self, metric: Metric, step: Granularity, batches: Sequence[Batch]) -> DataFrame:
        """All rows of some batches, with batch, role, partition and day."""
        base = f"{self._home(metric.name)}/{step.datapoint_us}"
        schema = f"primary_tag string, tags array<string>, block_us bigint, t_us bigint, seq bigint, {TYPES[metric.kind]}, batch string, role string, partition string, day bigint"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/batch={b.name}" for b in batches))

    def _stored(self, metric: Metric, step: Granularity, batches: Sequence[Batch]) -> DataFrame:
        """What queries see: stored points of all batches, open ones of the latest."""
        latest = batches[-1].name if batches else ""
        return self._files(metric, step, batches).filter((F.col("role") == "stored") | ((F.col("role") == "open") & (F.col("batch") == latest)))

    def _write(self, metric: Metric, step: Granularity, batch: str, rows: DataFrame) -> tuple:
        """rows, with a column role, as files of one batch; what the commit says of them."""
        placed = rows.withColumns({"partition": _partition(metric), "day": F.expr(f"floor(t_us / {DAY}L)")})
        path = f"{self._home(metric.name)}/{step.datapoint_us}/batch={batch}"
        placed.hint("rebalance", "role", "partition", "day").sortWithinPartitions("role", "partition", "day", "t_us").write.partitionBy("role", "partition", "day").parquet(path)
        seen = self._files(metric, step, [Batch(0, batch, False, {}, {})]).agg(F.min(F.when(F.col("role") != "late", F.col("t_us"))), F.max(F.when(F.col("role") != "late", F.col("t_us"))), F.count_if(F.col("role") == "late")).first()
        return (step.datapoint_us, *seen)

    def ingest(self, name: str, kind: str, points: DataFrame) -> DataFrame:
        """Store points (see operators.points) at each granularity; the points with a column rejected, null for those stored.

        A point that is late at one granularity isn't stored at finer ones. points is read several times and must be the same
        each time; seq tells its rows apart. The batch goes on where the one before ended.
        """
        metric = self.metric(name, kind)
        batches, batch, steps = self._batches(name), uuid.uuid4().hex, []
        valid = validated(points, kind).withColumn("primary_tag", primary_tag(F.col("tags"), metric.primary_tags, metric.primary_keys))
        good, late = valid.filter("rejected is null").drop("rejected"), None
        columns = ["primary_tag", "tags", "block_us", "t_us", "seq", *VALUES[kind]]
        for step in metric.granularities:
            opened = self._files(metric, step, batches[-1:]).filter("role = 'open'") if batches else None
            made = deal(good, kind, step.datapoint_us, step.block_us, opened)
            role = F.when(F.col("late"), "late").when(F.col("opened"), "open").otherwise("stored")
            steps.append(self._write(metric, step, batch, made.select(*columns, role.alias("role"))))
            if steps[-1][-1]:
                own = self._files(metric, step, [Batch(0, batch, False, {}, {})]).filter("role = 'late'").select("primary_tag", "seq")
                good = good.join(own, ["primary_tag", "seq"], "left_anti")
                late = own if late is None else late.union(own)
        self._commit(name, batches, batch, False, steps)
        if late is None:
            return valid
        found = late.withColumn("_late", F.lit("InvalidTimeOrder"))
        return valid.join(found, ["primary_tag", "seq"], "left").withColumn("rejected", F.coalesce("rejected", "_late")).select(*valid.columns)

    def compact(self, name: str) -> None:
        """Rewrite a metric as one batch, without the points that are older than each granularity keeps, and delete the batches before.

        Queries that began before read files that go; run it where none do.
        """
        metric, batches = self.metric(name), self._batches(name)
        if not batches:
            return
        batch, steps = uuid.uuid4().hex, []
        for step in metric.granularities:
            rows = self._stored(metric, step, batches)
            newest = _span(batches, step)[1]
            if step.keep_us is not None and newest is not None:
                rows = rows.filter((F.col("t_us") >= newest - step.keep_us) | (F.col("role") == "open"))
            steps.append(self._write(metric, step, batch, rows.drop("batch", "partition", "day")))
        self._commit(name, batches, batch, True, steps)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for step in metric.granularities:
            for old in batches:
                path = jvm.org.apache.hadoop.fs.Path(f"{self._home(name)}/{step.datapoint_us}/batch={old.name}")
                path.getFileSystem(conf).delete(path, True)

    def points(self, name: str, query: Query, window: float | None = None) -> tuple[str, DataFrame]:
        """(kind, points) that a query reads: of its granularity, within the days and partitions that can matter."""
        metric, batches = self.metric(name), self._batches(name)
        step = self._granularity(metric, batches, query, window)
        start, end = query.range_us
        newest = _span(batches, step)[1]
        if step.keep_us is not None and newest is not None:
            start = max(start, newest - step.keep_us)
        stored = self._stored(metric, step, batches)
        stored = stored.filter((F.col("day") >= start // DAY) & (F.col("day") <= end // DAY) & (F.col("t_us") >= start))
        asked = query.tags_filter.get("And", ()) if isinstance(query.tags_filter, dict) else ()
        named = possible_partitions(query.tags_filter, [t for t in asked if t in metric.primary_tags or t.split(":")[0] in metric.primary_keys])
        return metric.kind, stored.filter(F.col("partition").isin([*named, MIXED, DEFAULT])) if named else stored

    def _granularity(self, metric: Metric, batches: Sequence[Batch], query: Query, window: float | None) -> Granularity:
        """The first; but for windows of a gauge that are finer than it, the finest that holds the whole range."""
        base = metric.granularities[0]
        if metric.kind != "gauge" or window is None or window * SECOND >= base.datapoint_us:
            return base
        start, end = query.range_us
        for step in reversed(metric.granularities[1:]):
            low, high = _span(batches, step)
            if low is not None and low <= start and high >= end:
                return step
        return base

    def aggregate(self, name: str, operation: str, query: Query, window: float | None = None, percentile: float | None = None) -> DataFrame:
        kind, points = self.points(name, query, window)
        return aggregate(points, kind, operation, query, window, percentile)

    def compose(self, expression: Expression, window: float | None = None, output_filter: object = None) -> DataFrame:
        return compose(expression, self.points, window, output_filter)

    def request(self, text: str | dict) -> DataFrame:
        """The result of a JSON request, in the order of groups, then of windows."""
        made = self.compose(*request_of(text))
        keys = [k for k in ("group", "window_us") if k in made.columns]
        return made.orderBy(*keys) if keys else made

    def stats(self, name: str) -> DataFrame:
        metric = self.metric(name)
        return storage_stats(self._stored(metric, metric.granularities[0], self._batches(name)))
