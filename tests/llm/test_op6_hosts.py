"""Hosts whose documents fail too often are rejected whole, by shrunk rates: against SQL, where the method decides."""

import duckdb

from tempograin.llm import op6_quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_shrinkage_decides(spark, tmp_path):
    good, bad = " ".join(f"word{i}" for i in range(30)), "too short"
    rows = []
    # host, documents, of which fail
    hosts = [(None, 4, 3), ("tiny", 1, 1), ("large-bad", 60, 50), ("edge", 10, 7)] + [(f"fine{k}", 20 + k, k % 4) for k in range(12)]
    for host, n, failing in hosts:
        rows += [(len(rows) + i, bad if i < failing else good, "en", host, 1) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = dict(con.execute(f"select doc_id, kept from ({op6_quality_rules.SQL})").fetchall())
    made = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op6_quality_rules.digest(docs).collect()}
    assert {d: kept for d, (_, kept) in made.items()} == wanted
    rejected = {rows[d][3] for d, (failed, kept) in made.items() if not failed and not kept}
    assert "large-bad" in rejected and not any(h and h.startswith("fine") for h in rejected)
    rates = {r["host"]: r["shrunk_rate"] for r in op6_quality_rules.host_verdicts(docs.selectExpr("source", "text = 'too short' as failed"), "source", "failed").collect()}
    # a host of one failed document isn't judged by that alone
    assert rates["tiny"] < 1 and rates["tiny"] < rates["large-bad"]
    kept = {r["doc_id"] for r in op6_quality_rules.keep_good(docs).collect()}
    assert kept == {d for d, k in wanted.items() if k}
