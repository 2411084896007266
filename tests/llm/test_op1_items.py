"""Test items with null and repeated ids, in one block and in several."""

import pytest

from tempograin.llm import op1_decontaminate


@pytest.mark.parametrize("items", [20_000, 1])
def test_every_row_of_the_test_set_counts(spark, monkeypatch, items):
    monkeypatch.setattr(op1_decontaminate, "BLOCK_ITEMS", items)
    texts = [f"which {a} flows through the {a} valley near old {a} town. the {a} river of {a} stone" for a in ("amber", "birch", "cedar", "delta")]
    bench = spark.createDataFrame([(None, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (8, texts[3])], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"some words before {t} and some after") for i, t in enumerate(texts)] + [(9, texts[1] + " " + texts[2]), (10, "nothing"), (11, None)], "doc_id bigint, text string")
    made = sorted(((r["doc_id"], r["item_id"]) for r in op1_decontaminate.leaked_pairs(docs, bench).collect()), key=str)
    assert made == [(0, None), (1, 7), (2, 7), (3, 8), (9, 7)]
    kept = op1_decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [10, 11]


def test_question_and_answer_have_to_be_near(spark):
    words = " ".join(f"filler{i}" for i in range(9_000))
    question, answer = "which amber river flows through the amber valley near old amber town.", "the long amber river of grey stone"
    bench = spark.createDataFrame([(1, f"{question} {answer}")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{question} {answer}"), (2, f"{words} {question} {answer} {words}"), (3, f"{question} {words} {answer}")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in op1_decontaminate.leaked_pairs(docs, bench).collect()) == [1, 2]


def test_long_items_are_found_over_several_passages(spark):
    item = " ".join(f"long{i}" for i in range(1_000)) + ". " + " ".join(f"end{i}" for i in range(300))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "x " * i + item + " y" * 50) for i in (0, 1, 63, 127, 128, 500)], "doc_id bigint, text string")
    assert op1_decontaminate.leaked_pairs(docs, bench).count() == 6
