"""The pipeline's near-duplicate stage against brute force over five-word shingles at 80 %, and the stages after it."""

import random
from itertools import combinations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tempograin.llm.common import shared_folder  # noqa: E402

from .test_operators import DATA, leaks_brute  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def firsts(rows):
    """The least doc_id of each class."""
    grams = {}
    for i, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
        w = [x for x in w if x]
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in grams}

    def find(x):
        return x if least[x] == x else find(least[x])

    for a, b in combinations(grams, 2):
        small, large = sorted((len(grams[a]), len(grams[b])))
        if small and 100 * small >= 80 * large and 100 * (n := len(grams[a] & grams[b])) >= 80 * (small + large - n):
            x, y = sorted((find(a), find(b)))
            least[y] = x
    return {i for i in grams if find(i) == i}


def test_copies_with_text_appended_or_words_changed(spark):
    rng, words = random.Random(4), [f"w{i}" for i in range(2000)]
    made = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for n in (40, 100, 250, 600, 1500):
        base = made(n)
        rows.append(base)
        rows += [base + made(n * k // 100) for k in (5, 12, 18, 24, 26, 35)]
        for percent in (1, 2, 3):
            near = list(base)
            for at in rng.sample(range(n), max(1, n * percent // 100)):
                near[at] = "changed"
            rows.append(near)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, DATA).collect()}
    assert kept == firsts([r[:2] for r in rows])


def test_stages_after_it(spark):
    shared_folder(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    near = STAGES["near_duplicates"](spark, docs, DATA).checkpoint()
    kept = {r["doc_id"]: r["text"] for r in near.collect()}
    assert near.columns == list(corpus_pipeline.COLUMNS)
    assert set(kept) == firsts([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    clean = STAGES["decontaminate"](spark, near, DATA).checkpoint()
    assert {r["doc_id"] for r in clean.collect()} == {d for d, t in kept.items() if not leaks_brute(t, items)}
    assert STAGES["encode"](spark, clean, DATA).count() == clean.count()
