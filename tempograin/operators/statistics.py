"""Statistics of stored points, histogram percentiles, deltas between samples, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import divide


def storage_stats(stored: DataFrame) -> DataFrame:
    """primary_tag, n_blocks, n_points, max_sub_block (most points of one set of tags in a block)."""
    parts = stored.groupBy("primary_tag", "block_us", F.array_sort("tags").alias("tagset")).agg(F.count("*").alias("n"))
    return parts.groupBy("primary_tag").agg(F.count_distinct("block_us").alias("n_blocks"), F.sum("n").alias("n_points"), F.max("n").alias("max_sub_block"))


def range_stats(points: DataFrame, value: str = "value") -> DataFrame:
    return points.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def histogram_percentile(df: DataFrame, value: str, percentile: float, low: float, high: float, buckets: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys and percentile, from the counts of equal buckets of [low, high); interpolated within the bucket that holds the rank. Values outside are left out."""
    width = (high - low) / buckets
    x = F.col(value).cast("double")
    counts = df.filter((x >= low) & (x < high)).groupBy(*keys, F.floor((x - low) / width).alias("bucket")).agg(F.count("*").alias("n"))
    # at most `buckets` rows by key, so these windows are small
    upto = Window.partitionBy(*keys).orderBy("bucket")
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*keys))})
    rank = F.col("total") * (percentile / 100)
    hit = ranked.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    inside = (rank - (F.col("upto") - F.col("n"))) / F.col("n")
    return hit.select(*keys, (low + (F.col("bucket") + inside) * width).alias("percentile"))


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, low, high, buckets, bucket, n: counts of equal buckets between the least and the largest value; as many as the root of the count, rounded up. Other rows than NaN and null count."""
    x = F.col(value).cast("double")
    values = df.filter(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"))
    spans = values.groupBy(*keys).agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.ceil(F.sqrt(F.count("*"))).alias("buckets"))
    return _counted(values.withColumn("_n", F.lit(1)), spans, keys)


def _counted(values: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts _n of values _x in the buckets of spans, which has a row for each combination of keys."""
    met = values.join(spans, [*keys]) if keys else values.crossJoin(F.broadcast(spans))  # without keys, spans is a single row
    place = F.floor((F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("buckets"))
    bucket = F.when(F.col("high") > F.col("low"), F.least(place, F.col("buckets") - 1)).otherwise(F.lit(0))
    return met.groupBy(*keys, "low", "high", "buckets", bucket.cast("long").alias("bucket")).agg(F.sum("_n").alias("n"))


def merge_histograms(histograms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One histogram for each combination of keys of rows as histogram() makes them: each bucket's count goes to the new bucket of its middle."""
    middle = F.col("low") + (F.col("bucket") + 0.5) / F.col("buckets") * (F.col("high") - F.col("low"))
    spans = histograms.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.ceil(F.sqrt(F.sum("n"))).alias("buckets"))
    return _counted(histograms.select(*keys, middle.alias("_x"), F.col("n").alias("_n")), spans, keys)


def percentile_of(histograms: DataFrame, percentile: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, percentile: interpolated within the bucket that holds the rank, which is rounded to a whole count."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    ranked = histograms.withColumns({"_upto": F.sum("n").over(order), "_rank": F.round(F.sum("n").over(Window.partitionBy(*keys)) * (percentile / 100))})
    hit = ranked.filter((F.col("_upto") >= F.col("_rank")) & ((F.col("_upto") - F.col("n") < F.col("_rank")) | ((F.col("_upto") == F.col("n")) & (F.col("_rank") == 0))))
    inside = (F.col("_rank") - (F.col("_upto") - F.col("n"))) / F.col("n")
    return hit.select(*keys, (F.col("low") + (F.col("bucket") + inside) / F.col("buckets") * (F.col("high") - F.col("low"))).alias("percentile"))


def ratio_extremes(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, least, most: the pairs (num, den) of the least and the largest ratio, the earlier one at a tie. Pairs without denominator are left out."""
    pair, by = F.struct("num", "den"), F.col("num") / F.col("den")
    first = lambda sign: F.min(F.struct((sign * by).alias("by"), "t_us", "seq", pair.alias("pair")))["pair"]
    return points.filter("den <> 0").groupBy(*keys).agg(first(1).alias("least"), first(-1).alias("most"))


def deltas(samples: DataFrame, keys: Sequence[str], time: str, counters: Sequence[str]) -> DataFrame:
    """samples with a column d_<counter> each: the change since the sample before of the same keys; the first one has none."""
    order = Window.partitionBy(*keys).orderBy(time)
    return samples.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(order) for c in counters})


def usage(idle: Column, total: Column) -> Column:
    """The share of time that wasn't idle, from both deltas."""
    return 1 - divide(idle.cast("double"), total.cast("double"))


def retained(points: DataFrame, keep_us: int, newest: int) -> DataFrame:
    """points not older than keep_us before newest."""
    return points.filter(F.col("t_us") >= newest - keep_us)
