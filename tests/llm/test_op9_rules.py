"""Wildcards and odd characters in rules and urls, against a plain matcher."""

import random

import pytest

from tempograin.llm import op9_url_filters as op9


def fits(host, path, rule):
    rule_host, slash, rule_path = rule.partition("/")
    return f".{host}".endswith(f".{rule_host}") and path.startswith(slash + rule_path)


def test_rules_are_literal():
    rng = random.Random(2)
    piece = lambda n: "".join(rng.choice("ab.*?\\\0/") for _ in range(rng.randrange(n)))
    rules = ["net/a*b/", "net/es/", "a?/", "b\\c/x"] + [x for _ in range(60) if "\0" not in (x := piece(4).replace("/", "") + "/" + piece(3))]
    urls = [("x.net", "/aZZb/"), ("x.net", "/a*b/c"), ("a.org", "/x.net\0/es/"), ("q.net", "/es/"), ("b\\c", "/x")] + [(piece(5).replace("/", ""), "/" + piece(4)) for _ in range(300)]
    made = op9.Automaton([op9.rule_glob(r) for r in rules]).matches([op9.canonical(h, p) for h, p in urls])
    assert [[bool(x) for x in row] for row in made] == [[fits(h, p, r) for r in rules] for h, p in urls]
    with pytest.raises(ValueError):
        op9.rule_glob("a\0b/")


def glob_fits(glob, text):
    """By a table over prefixes of both."""
    row = [True] + [False] * len(text)
    for c in glob:
        new = [row[0] and c == "*"]
        for i, t in enumerate(text):
            new.append(row[i + 1] or new[-1] if c == "*" else row[i] and c in ("?", t))
        row = new
    return row[-1]


def test_globs():
    rng = random.Random(4)
    globs = ["*a?b*", "?", "*", "a*b*c", "**a"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 70))) for _ in range(40)]
    texts = [""] + ["".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(200)]
    made = op9.Automaton(globs).matches(texts)
    for t, row in zip(texts, made, strict=True):
        assert [bool(x) for x in row] == [glob_fits(g, t) for g in globs]


def test_tables(spark):
    rows = [(1, "http://a.org/x.net\0/es/", 7, "k"), (1, "http://a.org/x.net\0/es/", 7, "k"), (2, None, 7, "k"), (3, "http://" + "s." * 50_000 + "net/es/" + "p" * 50_000, 7, "k")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, judged int, `rule` string")
    made = op9.judge_urls(pages, out="own")
    assert made.columns == [*pages.columns, "own"]
    got = sorted((r["page_id"], r["own"]["rule"], r["own"]["verdict"]) for r in made.collect())
    assert got == [(1, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, "net/es/", "block")]
