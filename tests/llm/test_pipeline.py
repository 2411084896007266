"""The pipeline against SQL and brute force, stage by stage."""

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tempograin.llm import op6_quality_rules, op7_line_dedup  # noqa: E402

from .test_operators import DATA, leaks_brute  # noqa: E402
from .test_pipeline_near_copies import firsts  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    con = duckdb.connect()
    for name, stage in corpus_pipeline.STAGES:
        con.execute("drop view if exists documents")
        docs.write.parquet(f"{tmp_path}/{name}-in")
        con.execute(f"create view documents as from '{tmp_path}/{name}-in/*.parquet'")
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality":
            assert set(after) == {d for d, kept in con.execute(f"select doc_id, kept from ({op6_quality_rules.SQL})").fetchall() if kept}
        if name == "line_dedup":
            import hashlib

            wanted = dict(con.execute(f"select doc_id, kept_sha256 from ({op7_line_dedup.SQL})").fetchall())
            assert {d: hashlib.sha256(r["text"].encode()).hexdigest() for d, r in after.items()} == wanted
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "near_duplicates":
            # the stage joins at five words and 80 %, op8's SQL at three and 90
            assert set(after) == firsts([(d, r["text"] or "") for d, r in before.items()])
        if name == "decontaminate":
            assert set(after) == {d for d, r in before.items() if not leaks_brute(r["text"], items)}
        if name == "encode":
            assert set(after) == set(before) and all(r["n_tokens"] == len(r["ids"]) for r in after.values())
