"""Lines that very many documents share go by another way than the others, with the same result."""

from tempograin.llm import op7_line_dedup


def test_hot_lines(spark, monkeypatch):
    rows = [(i, f"everywhere\nline {i // 15}\nown {i}\n\n EVERYWHERE ") for i in range(300)] + [(None, "everywhere"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = []
    for share in (0, 2, 1_000):
        monkeypatch.setattr(op7_line_dedup, "HOT_SHARE", share)
        made.append(sorted(map(str, op7_line_dedup.digest(docs).collect())))
    assert made[0] == made[1] == made[2]
    kept, out = op7_line_dedup.drop_shared_lines(docs)
    assert {r["doc_id"]: r[out]["text"] for r in kept.filter("doc_id < 7").collect()} == {i: f"own {i}\n" for i in range(7)}
