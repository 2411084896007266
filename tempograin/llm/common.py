"""Reading tables and cutting lineage, shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only on a single machine where it is unset."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; later plans start from those files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again. Made once; later uses read only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, body) -> Column:
    """body(v), where v is value computed once; a column named twice inside a lambda is computed for each element."""
    return F.transform(F.array(value), body)[0]


#: Bits of the filter that may_be_in() broadcasts (16 MB), whatever the number of keys.
FILTER_BITS = 1 << 27


def may_be_in(df: DataFrame, key: Column, keys: DataFrame, out: str) -> DataFrame:
    """df with a boolean column out: false only if key (never null) isn't in keys, a DataFrame of one column.

    Keys set bits of a bitmap of fixed size, so what is broadcast doesn't grow with them; the more keys, the more rows
    pass that needn't. An exact join of those that pass has to follow.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    part, bits, own = (own_name(df, n) for n in ("filter_part", "filter_bits", "filter_at"))
    set_bits = keys.select(at(F.col(keys.columns[0])).alias("at")).groupBy(F.bitmap_bucket_number("at").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bits))
    placed = df.withColumn(own, at(key)).join(F.broadcast(checkpoint(set_bits)), F.bitmap_bucket_number(F.col(own)) == F.col(part), "left")
    bit = F.bitmap_bit_position(F.col(own))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({own}) % 8 as int))")) != 0
    return placed.withColumn(out, F.coalesce(hit, F.lit(False))).drop(own, part, bits)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
