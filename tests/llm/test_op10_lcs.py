"""The longest common subsequence of lines against a table, and texts that don't depend on how pages are dealt."""

import random

from tempograin.llm import op10_html_extraction as op10


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_lines():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(op10.common_lines(a, b))
        assert len(found) == longest(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)


def test_same_text_under_any_partitioning(spark):
    shell = "<body><div>top menu</div><div>site title</div>{}<div>terms of use</div></body>"
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/a/{i:03}", shell.format("".join(f"<p>page {i} line {k}</p>" for k in range(3)))) for i in range(60)], "page_id bigint, url string, html string")
    made = []
    for n in (1, 3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        made.append({r["page_id"]: r["text"] for r in op10.extract(pages.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1] == made[2] == {i: " ".join(f"page {i} line {k}" for k in range(3)) for i in range(60)}
    # without neighbours nothing tells the shell from the text
    alone = {r["page_id"]: r["text"] for r in op10.extract(pages.filter("page_id < 3")).collect()}
    assert all("top menu" in alone[i] for i in range(3))
