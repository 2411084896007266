"""Planted identifiers that no base pattern finds: how many are discovered, and that none are without the method."""

import random

from tempograin.llm import op4_pii

FRAMES = {
    3: ("please call us at {} before noon", "my new number is {} from monday", "fax it to {} or write"),
    2: ("charged to card {} on friday", "the account {} was closed", "pay with card {} instead"),
    0: ("send mail to {} for details", "write to {} about this", "reach me under {} any time"),
}


def planted(rng):
    """(base form, form that no base pattern matches) of each kind."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(right):
        while True:
            d = "4" + digits(15)
            if op4_pii.luhn(d) == right:
                return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    number = f"{digits(2)}-{digits(4)}"
    return {3: (f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) 555-{number[-4:]}"), 2: (card(True), card(False)), 0: (f"u{digits(5)}@mail.example.org", f"u{digits(5)}@intranet")}


def corpus(rng, n):
    rows, wanted = [], set()
    for i in range(n):
        kind = rng.choice([0, 2, 3])
        known, unseen = planted(rng)[kind]
        hidden = rng.random() < 0.15
        text = f"some text here. {rng.choice(FRAMES[kind])}. and {rng.randrange(10**9)} things cost {rng.random():.2f} euro".format(unseen if hidden else known)
        rows.append((i, text))
        if hidden:
            start = text.index(unseen)
            wanted.add((i, f"{op4_pii.KINDS[kind]}:{start}:{start + len(unseen)}"))
    return rows, wanted


def test_recall_and_precision_of_planted_identifiers(spark, monkeypatch):
    rows, wanted = corpus(random.Random(11), 1_500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def discovered():
        out = set()
        for r in op4_pii.digest(docs).collect():
            base = {f"{op4_pii.KINDS[k]}:{s}:{e}" for s, k, e in op4_pii.base_spans(rows[r["doc_id"]][1])}
            out |= {(r["doc_id"], x) for x in r["spans"].split(",") if x and x not in base}
        return out

    found = discovered()
    assert len(wanted) > 150
    assert len(found & wanted) / len(wanted) >= 0.9
    assert len(found & wanted) / len(found) >= 0.9
    monkeypatch.setattr(op4_pii, "ROUNDS", 0)
    assert discovered() == set()


def test_candidates_of_any_length_and_whole_words():
    long = "1" * 40 + "@" + "b" * 200
    assert [op4_pii.shape(x) for x in (long,)] == [[0]]
    text = f"{'w' * 300} to {long} {'z' * 300} end"
    (row,) = op4_pii.found_in(text)["seen"]
    assert row["value"] == long and row["patterns"] == [f"{'w' * 300} to *", f"to * {'z' * 300}"]
    for t in ("call me at (017) 555-7713 today", "x (017) 555-7713, y", "\n(017) 555-7713"):
        assert [t[a:b] for a, b in op4_pii.candidates(t)] == ["(017) 555-7713"]
    # as many base spans as one likes may lie before a token that overlaps one
    many = " ".join(f"10.0.0.{i}" for i in range(50)) + " 10.1.1.1x5"
    assert all(r["kind"] >= 0 for r in op4_pii.found_in(many)["seen"])


def test_very_long_text(spark):
    text = "word " * 200_000 + "mail a@b.org now " + "7" * 100_000 + " " + "9@" * 50_000
    r = op4_pii.digest(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["n_email"]) for x in r) == [(0, 0), (1, 1), (1, 1)]
