"""Late points, blocks, and the storage of close points as one.

Points of a primary tag are taken in order of arrival. Its active block starts with a point; the first point that is at least
one block length after that start begins the next block. In a block, a point close to the latest stored point (the anchor) of
its own set of tags merges into that; any other is stored. A point before the newest anchor of its block is late.

A block begins with a point newer than all before it, so the chain of block starts runs over such points alone. It is
sequential, so times are cut into chunks of CHUNK_STEPS block lengths. Each chunk tells for every possible first start what its
last one would be (as runs, since chains soon merge); those few runs are followed chunk by chunk. Each chunk then deals
its own points, batch by batch in order of arrival, with one open point for each set of tags; points of the block that a
chunk begins in go to the chunk before. So no task holds a chunk or a primary tag as a whole, but for a chunk's distinct times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .points import VALUES

CHUNK_STEPS = 8
#: Rows that are folded at once, at least.
FOLD_ROWS = 1 << 16
#: Arrivals whose running maximum one task computes.
ARRIVALS = 1 << 20
_NEVER = -(1 << 62)
#: Types of stored values, in SQL and Arrow.
TYPES = {"gauge": "value float", "count": "count bigint", "ratio": "num bigint, den bigint"}
_ARROW = {"gauge": [("value", pa.float32())], "count": [("count", pa.int64())], "ratio": [("num", pa.int64()), ("den", pa.int64())]}


def _changes(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """For each row whether its keys differ from the row before; the first row counts as different."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = batch.column(k)
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return new


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) of whole groups of sorted rows, many at a time; starts: where groups start, and the end."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        return rows, np.append(np.flatnonzero(_changes(rows, keys)), rows.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(_changes(batch, keys))
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            starts = starts[1:]
        if len(starts):
            last = int(starts[-1])
            if parts := held + ([batch.slice(0, last)] if last else []):
                yield out(parts)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield out(held)


def _many(batches: Iterator[pa.RecordBatch], least: Callable[[], int]) -> Iterator[pa.Table]:
    """Rows of batches that follow each other, least() or more at a time but for the last ones."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
        if parts and sum(x.num_rows for x in parts) >= least():
            yield pa.Table.from_batches(parts).combine_chunks()
            parts = []
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _runs(times: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(last first anchor, last anchor) of each run of first anchors that lead to the same last anchor. times: sorted, distinct."""
    first = times[: np.searchsorted(times, times[0] + step, side="right") + 1]
    at = np.arange(len(first))
    while True:
        after = np.searchsorted(times, times[at] + step)
        more = after < len(times)
        if not more.any():
            break
        at = np.where(more, after, at)
    ends = np.flatnonzero(np.append(at[1:] != at[:-1], True))
    return first[ends], times[at[ends]]


def _chunk_of(times: str, us: int) -> str:
    """times divided by us and rounded down, also before the epoch."""
    return f"({times} - pmod({times}, {us}L)) div {us}L"


def _summaries(points: DataFrame, step: int) -> DataFrame:
    """primary_tag, chunk, upto, last, least, most, ordered: the runs of each chunk of time; its first and last arrival (_order), and whether times rise with arrivals."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, ["primary_tag", "chunk"]):
            times, order = _numbers(rows, "t_us"), _numbers(rows, "_order")
            own, made = [], [[], [], [], [], []]
            for a, b in zip(starts, starts[1:], strict=False):
                upto, last = _runs(np.unique(times[a:b]), step)
                own.append(np.full(len(upto), a))
                about = (int(order[a:b].min()), int(order[a:b].max()), bool((order[a + 1 : b] >= order[a : b - 1]).all()))
                for column, x in zip(made, (upto, last, *(np.full(len(upto), x) for x in about)), strict=True):
                    column.append(x)
            out = rows.select(["primary_tag", "chunk"]).take(pa.array(np.concatenate(own)))
            for name, x in zip(("upto", "last", "least", "most", "ordered"), made, strict=True):
                out = out.append_column(name, pa.array(np.concatenate(x)))
            yield from out.to_batches()

    narrow = points.select("primary_tag", F.expr(_chunk_of("t_us", step * CHUNK_STEPS)).alias("chunk"), "t_us", "_order")
    by = ["primary_tag", "chunk"]
    return narrow.repartition(*by).sortWithinPartitions(*by, "t_us", "_order").mapInArrow(summary, "primary_tag string, chunk bigint, upto bigint, last bigint, least bigint, most bigint, ordered boolean")


def _follow(summaries: DataFrame, step: int) -> DataFrame:
    """primary_tag, chunk, allowed, newest: the first time that can start a block in each chunk; the start of the primary tag's last block."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, allowed = None, _NEVER
        for rows, starts in _whole_groups(batches, ["primary_tag", "chunk"]):
            upto, last, needs, reached = _numbers(rows, "upto"), _numbers(rows, "last"), [], []
            for a, b in zip(starts, starts[1:], strict=False):
                now = rows.column("primary_tag")[int(a)].as_py()
                key, allowed = now, allowed if now == key else _NEVER
                needs.append(allowed)
                run = int(a + np.searchsorted(upto[a:b], allowed))
                allowed = int(last[run]) + step if run < b else allowed
                reached.append(allowed - step)
            made = rows.select(["primary_tag", "chunk"]).take(pa.array(starts[:-1]))
            yield from made.append_column("allowed", pa.array(needs, pa.int64())).append_column("newest", pa.array(reached, pa.int64())).to_batches()

    chain = summaries.repartition("primary_tag").sortWithinPartitions("primary_tag", "chunk", "upto").mapInArrow(follow, "primary_tag string, chunk bigint, allowed bigint, newest bigint")
    return chain.withColumn("newest", F.max("newest").over(Window.partitionBy("primary_tag")))


def _in_order(summaries: DataFrame) -> bool:
    """Whether later times arrived later, in every chunk and from chunk to chunk."""
    chunks = summaries.groupBy("primary_tag", "chunk").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.bool_and("ordered").alias("ordered"))
    before = F.max("most").over(Window.partitionBy("primary_tag").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("before", before).filter("not ordered or least < before").isEmpty()


def _newest_before(points: DataFrame) -> DataFrame:
    """points with a column _newest: the newest time of its primary tag among earlier arrivals (_order, then t_us), or null.

    Running maxima go by chunks of arrivals, then over the chunks.
    """
    chunked = points.withColumn("_chunk", F.expr(f"_order div {ARRIVALS}"))
    tops = chunked.groupBy("primary_tag", "_chunk").agg(F.max("t_us").alias("_top"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("primary_tag", "_chunk", F.max("_top").over(upto.partitionBy("primary_tag").orderBy("_chunk")).alias("_before"))
    inside = F.max("t_us").over(upto.partitionBy("primary_tag", "_chunk").orderBy("_order", "t_us"))
    return chunked.join(before, ["primary_tag", "_chunk"]).withColumn("_newest", F.greatest("_before", inside)).drop("_before", "_chunk")


def reject_late(points: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """points with a column late: whether a point of the same primary tag that arrived before it is newer, stored or merged.

    latest: primary_tag, latest of what is stored already.
    """
    out = _newest_before(points.withColumn("_order", F.col("seq")))
    if latest is not None:
        out = out.join(latest, "primary_tag", "left").withColumn("_newest", F.greatest("_newest", "latest")).drop("latest")
    return out.withColumn("late", F.coalesce(F.col("t_us") < F.col("_newest"), F.lit(False))).select(*points.columns, "late")


def _anchored(time: np.ndarray, series: np.ndarray, near: int) -> np.ndarray:
    """The first row of each stored point. Rows are sorted by series, and by time within."""
    span = int(time.max() - time.min()) + near + 1
    apart = time - time.min() + series.astype(np.int64) * span  # later series lie beyond any step from here
    after = np.searchsorted(apart, apart + near).tolist()
    out, at = [], 0
    while at < len(after):
        out.append(at)
        at = after[at]
    return np.array(out, np.int64)


def _one_by_one(time: np.ndarray, tagset: np.ndarray, near: int) -> np.ndarray:
    """For each arrival of one block the arrival that it is stored with, or -1 if it is late."""
    newest, anchors, out = _NEVER, {}, []
    for i, (t, tags) in enumerate(zip(time.tolist(), tagset.tolist(), strict=True)):
        if t < newest:
            out.append(-1)
            continue
        if tags not in anchors or t - time[anchors[tags]] >= near:
            anchors[tags] = i
            newest = t
        out.append(anchors[tags])
    return np.array(out, np.int64)


def owners(time: np.ndarray, tagset: np.ndarray, new: np.ndarray, near: int) -> np.ndarray:
    """For each row the row that it is stored with, or -1 if it is late. Rows are in order of arrival by blocks, which start where new is true."""
    block = np.cumsum(new) - 1
    back = np.flatnonzero((time[1:] < time[:-1]) & ~new[1:]) + 1
    _, code = np.unique(tagset, return_inverse=True)
    odd = np.isin(block, block[back])
    out = np.empty(len(time), np.int64)
    usual = np.flatnonzero(~odd)
    if len(usual):
        series = (block * (int(code.max()) + 1) + code)[usual]
        sort = np.argsort(series, kind="stable")
        order = usual[sort]
        rank = np.cumsum(np.append(False, np.diff(series[sort]) != 0))
        first = _anchored(time[order], rank, near)
        out[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    for b in np.unique(block[back]):
        at = np.flatnonzero(block == b)
        found = _one_by_one(time[at], tagset[at], near)
        out[at] = np.where(found < 0, -1, at[found])
    return out


def _fold(rows: pa.Table, kind: str, near: int) -> pa.Table:
    """Stored and late points of rows sorted by block and arrival, which hold blocks from their start on; with columns late and last (of its set of tags in its block)."""
    tagset, new = _numbers(rows, "tagset"), _changes(rows, ("primary_tag", "block_us"))
    owner = owners(_numbers(rows, "t_us"), tagset, new, near)
    late = owner < 0
    owner[late] = np.flatnonzero(late)
    # by owner, then arrival
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1]))
    kept = owner[order][starts]
    made = rows.select(["primary_tag", "tags", "tagset", "block_us", "newest", "t_us", "seq"]).take(pa.array(kept))
    ends = np.append(starts[1:], len(order)) - 1
    for name, type_ in _ARROW[kind]:
        x = _numbers(rows, name)[order]
        made = made.append_column(name, pa.array(x[ends] if kind == "gauge" else np.add.reduceat(x, starts), type_))
    # stored points of one set of tags in one block follow each other in time; the last one is found from behind
    stored = np.flatnonzero(~late[kept])[::-1]
    block = np.cumsum(new)[kept[stored]]
    _, code = np.unique(tagset[kept[stored]], return_inverse=True)
    last = np.zeros(len(kept), bool)
    last[stored[np.unique(block * (len(stored) + 1) + code, return_index=True)[1]]] = True
    return made.append_column("late", pa.array(late[kept])).append_column("last", pa.array(last))


def block_starts(upto: np.ndarray, starts: np.ndarray, start: int | None, step: int) -> np.ndarray:
    """The block start of each row. upto: newest time so far, by groups; start: the active block of the first group, if it goes on."""
    out = np.empty(len(upto), np.int64)
    for a, b in zip(starts, starts[1:], strict=False):
        while a < b:
            start = int(upto[a]) if start is None or upto[a] >= start + step else start
            end = int(a + np.searchsorted(upto[a:b], start + step))
            out[a:end] = start
            a = end
        start = None
    return out


def _fold_groups(kind: str, near: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Some batches at a time; of a block that goes on in the next ones, the open points wait and arrive first there.

    There are at least as many new rows as waiting ones, so these are folded again a bounded number of times however many sets
    of tags a block has.
    """
    columns = ["primary_tag", "tags", "tagset", "block_us", "newest", "t_us", "seq", *(n for n, _ in _ARROW[kind])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        key, start = None, None
        opened = lambda made: pc.and_(made.column("last"), pc.equal(made.column("block_us"), made.column("newest")))
        out = lambda made: made.append_column("opened", opened(made)).drop_columns(["tagset", "newest", "last"]).to_batches()
        for batch in _many(batches, lambda: max(FOLD_ROWS, held.num_rows if held is not None else 0)):
            first, end = ([batch.column(k)[i].as_py() for k in ("primary_tag", "group")] for i in (0, batch.num_rows - 1))
            starts = np.append(np.flatnonzero(_changes(batch, ("primary_tag", "group"))), batch.num_rows)
            blocks = block_starts(_numbers(batch, "_upto"), starts, start if first == key else None, step)
            key, start = end, int(blocks[-1])
            rows = batch.append_column("block_us", pa.array(blocks)).filter(pc.invert(batch.column("_seed"))).select(columns)
            # computed columns and those from Spark differ in whether they may be null
            rows = rows if held is None else pa.concat_tables([held.select(columns), rows.cast(held.select(columns).schema)])
            if not rows.num_rows:
                continue
            made = _fold(rows.combine_chunks(), kind, near)
            wait = pc.and_(made.column("last"), pc.and_(pc.equal(made.column("primary_tag"), key[0]), pc.equal(made.column("block_us"), start)))
            yield from out(made.filter(pc.invert(wait)))
            held = made.filter(wait).sort_by("t_us")
        if held is not None:
            yield from out(held)

    return fold


def deal(points: DataFrame, kind: str, datapoint_us: int, block_us: int, opened: DataFrame | None = None) -> DataFrame:
    """primary_tag, tags, block_us, t_us, seq, values, late, opened of stored points (at the anchor's time) and of late ones (as they came).

    A gauge keeps the value that arrived last, counts and ratios add up. opened: the newest stored point of its set of tags in
    the last block of its primary tag, which later points can still merge into. The argument opened: those of the batch before,
    which this batch goes on from and returns again. Equal sets of tags are found by a 64-bit hash. Runs a job for the order
    of arrivals.
    """
    columns = ["primary_tag", "tags", "t_us", "seq", *VALUES[kind]]
    rows = points.select(*columns, F.col("seq").alias("_order"), F.lit(False).alias("_seed"))
    if opened is not None:
        zero = lambda v: F.lit(0).cast(opened.schema[v].dataType).alias(v)
        seeds = opened.groupBy("primary_tag").agg(F.min("block_us").alias("t_us")).select("primary_tag", F.array().cast("array<string>").alias("tags"), "t_us", F.lit(0).cast("long").alias("seq"), *map(zero, VALUES[kind]), F.lit(_NEVER).alias("_order"), F.lit(True).alias("_seed"))
        rows = rows.union(opened.select(*columns, F.lit(_NEVER + 1).alias("_order"), F.lit(False).alias("_seed"))).union(seeds)
    # few rows for each chunk, read twice
    summaries = _summaries(rows, block_us).persist()
    if _in_order(summaries):
        rows = rows.withColumn("_upto", F.col("t_us"))
    else:
        summaries.unpersist()
        rows = _newest_before(rows)
        summaries = _summaries(rows.filter("_newest is null or t_us > _newest"), block_us)
        rows = rows.withColumn("_upto", F.greatest("t_us", "_newest"))
    needs = _follow(summaries, block_us)
    placed = rows.withColumn("chunk", F.expr(_chunk_of("_upto", block_us * CHUNK_STEPS))).join(needs, ["primary_tag", "chunk"])
    group = F.when(F.col("_upto") >= F.col("allowed"), F.col("chunk")).otherwise(F.col("chunk") - 1)
    placed = placed.select(*columns, "_order", "_upto", "_seed", "newest", F.xxhash64(F.array_sort("tags")).alias("tagset"), group.alias("group"))
    schema = f"primary_tag string, tags array<string>, block_us bigint, t_us bigint, seq bigint, {TYPES[kind]}, late boolean, opened boolean"
    by = ["primary_tag", "group"]
    return placed.repartition(*by).sortWithinPartitions(*by, "_order", "t_us").drop("_order").mapInArrow(_fold_groups(kind, datapoint_us, block_us), schema)


def coalesce_points(points: DataFrame, kind: str, datapoint_us: int, block_us: int) -> DataFrame:
    """primary_tag, tags, block_us, t_us, seq and values of the stored points of one batch."""
    return deal(points, kind, datapoint_us, block_us).filter("not late").drop("late", "opened")
