"""What a micro-batch of stream_gauge holds doesn't grow with the table."""

import duckdb
from pyspark.sql import functions as F

from tempograin import stored_queries

DATA = "/root/testdata/sf0.001"


def test_small_micro_batches_in_order_of_arrival(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_queries, "STREAM_ROWS", 90)
    monkeypatch.setattr(stored_queries, "scratch", lambda s, name: str(tmp_path))
    run, sql = stored_queries.pairs()["stream_gauge"]
    found = run(spark, DATA).select("primary_tag", "tag", "block_us", "t_us", "seq", "value").collect()
    con = duckdb.connect()
    con.execute(f"create view events as from '{DATA}/events.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(sql).fetchall())
    files = spark.read.parquet(str(tmp_path / "in")).groupBy(F.col("_metadata.file_modification_time").alias("made")).agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("made").collect()
    assert len(files) == 12 and max(f["n"] for f in files) <= 180
    assert all(a["high"] < b["low"] for a, b in zip(files, files[1:]))


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert stored_queries.pairs()["stream_gauge"][0](spark, str(tmp_path)).collect() == []


def test_tags_that_end_in_nul_stay_apart(spark, tmp_path):
    rows = [("p:1", ["k:1"], 0, 0, 1.0), ("p:1", ["k:1\0"], 1, 1, 2.0)]
    schema = "primary_tag string, tags array<string>, t_us bigint, seq bigint, value float"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stored_queries.dealt(read, "gauge", 100, 1000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    assert stored_queries.merged(spark.read.parquet(out), "gauge").count() == 2
