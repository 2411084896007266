"""Differencing of page pairs where copies, shared article lines and range edges matter."""

import pytest

from tempograin.llm import op10_html_extraction

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, rows):
    made = op10_html_extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in made) and len(made) == len(rows)
    return {r["page_id"]: r["text"] for r in made}


def test_copies_are_no_neighbours(spark):
    plain = "<body><p>shared menu</p><p>own {}</p><p>shared end</p>".format
    rows = [(i, f"http://b.org/p/1?visit={i}", plain(1)) for i in range(5)] + [(9, "http://b.org/p/2", plain(2))]
    assert texts(spark, rows) == {i: "own 1" for i in range(5)} | {9: "own 2"}


def test_common_lines_decide_inside_articles_too(spark):
    page = "<body><{0}><p>Subscribe now</p></{0}><article><p>{1}</p><p>quoted</p>{2}</article>".format
    rows = [(1, "http://c.org/a/1", page("article", "one", "")), (2, "http://c.org/a/2", page("div", "two", ""))]
    # the neighbour has the line outside its article; the quotation is in both articles
    assert texts(spark, rows) == {1: "one quoted", 2: "two quoted"}


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_edges_of_ranges(spark, parts):
    rows = [(i, f"http://d{i // 20}.org/x/{i:03}", f"<p>top {i // 20}</p><p>own {i}</p><p>top {i // 20}</p>") for i in range(60)]
    rows += [(100, "http://alone.org/", "<p>all</p><p>stays</p>"), (101, "http://d0.org/x/000/empty", "")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert texts(spark, rows) == {i: f"own {i}" for i in range(60)} | {100: "all stays", 101: ""}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
