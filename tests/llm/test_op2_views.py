"""Co-training: what each view teaches, and odd tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from tempograin.llm import op2_quality_classifier as op2

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n, told):
    """Both views tell the quality of most documents, each on its own; few are labelled."""
    rng, rows, labels = random.Random(6), [], []
    common = [f"w{i}" for i in range(300)]
    for i in range(n):
        good = rng.random() < 0.5
        words = [rng.choice(common) for _ in range(40)]
        words += [f"{'fine' if good ^ (rng.random() < 0.05) else 'poor'}{rng.randrange(60)}" for _ in range(3)]
        source = f"{'a' if good ^ (rng.random() < 0.02) else 'b'}{rng.randrange(8)}.org"
        toxic = rng.random() < 0.2
        rng.shuffle(words)
        rows.append((i, " ".join(words + ["idiot"] * toxic), "en", source, 300, good, toxic))
        if i < told:
            labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_both_views_teach(spark):
    rows, labels = corpus(1_500, 300)
    docs, known = spark.createDataFrame([r[:5] for r in rows], SCHEMA), spark.createDataFrame(labels, LABELS)
    prepared = op2._prepared(docs)
    trained = op2.co_train(prepared, op2._labelled(prepared, known, "quality"), known, 1)
    assert all(n > 20 for n in trained.lessons[0]), trained.lessons
    truth = {r[0]: r[5] for r in rows}

    made = {rounds: op2.score(docs, known, rounds).collect() for rounds in (0, 2)}

    def auc(rounds, column):
        scored = [(r[column], truth[r["doc_id"]]) for r in made[rounds] if r["doc_id"] >= 300]
        good, bad = (np.array([s for s, t in scored if t == y]) for y in (True, False))
        return np.mean([(g > bad).mean() for g in good])

    assert auc(2, "content_score") > auc(0, "content_score")
    assert auc(2, "quality") > 0.95
    kept = {r["doc_id"]: r["kept"] for r in made[2]}
    assert np.mean([not kept[r[0]] for r in rows if r[6]]) > 0.9


def test_odd_tables(spark):
    rows, labels = corpus(60, 60)
    odd = [(None, "null id", "en", "s", 1), (900, None, None, None, None), (901, "x " * 400_000, "en", "s", None), (902, "", "en", "s", 0), (902, "", "en", "s", 0)]
    docs = spark.createDataFrame([r[:5] for r in rows] + odd, SCHEMA).withColumns({"key": F.lit(1), "odds": F.lit("x"), "y": F.lit(2)})
    known = spark.createDataFrame([*labels, (None, 1, 0), (900, None, None), (0, 0, 1), (7_000, 1, 1)], LABELS)
    made = op2.score(docs, known, 1).collect()
    assert len(made) == 65 and all(r["quality"] is not None and r["toxic"] is not None for r in made)
    twice = [r for r in made if r["doc_id"] == 902]
    assert twice[0] == twice[1]
    # one document of a class
    for few in ([(i, int(i > 0), 0) for i in range(20)],):
        made = op2.score(docs, spark.createDataFrame(few, LABELS), 1).collect()
        assert len(made) == 65 and all(r["kept"] and r["quality"] is None and r["toxic"] is None for r in made)
