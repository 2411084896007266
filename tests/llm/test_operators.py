"""The numbered operators against brute force, other libraries and SQL, over small tables with nulls, ties, copies and clashing names."""

import hashlib
import random
import re
import struct
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.llm import op1_decontaminate, op2_quality_classifier, op3_bpe, op4_pii, op5_secrets, op6_quality_rules, op7_line_dedup, op8_ngram_jaccard, op9_url_filters, op10_html_extraction
from tempograin.llm.queries import queries, vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ("id", "row", "set", "host", "key", "leaks", "quality", "kept_lines", "kept_id", "all_stay", "fingerprint", "bpe", "Quality_m", "n_docs", "shrunk_rate", "host_rejected", "tile", "node", "first", "found", "owner", "hash")


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \n\t", "one", "Two words", "\n\na\n\n", "x " * 3_000, "ünï cödé 🙂 " * 20, "same line\n" * 4, "\x00\x1f\u2028 odd\u00a0space \U0001f600"]
    out += ["a\n Common LINE \nb", "COMMON line\nplain\tcommon line"] * 6
    base = [rng.choice(words) for _ in range(400)]
    for i in range(30):
        near = list(base)
        for _ in range(i % 8):
            near[rng.randrange(400)] = "changed"
        out.append(" ".join(near))
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 60))) for _ in range(60)]
    return out + out[:12]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}.org", None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/x?y#z", "http://example.com/en/", "http://a.example.com/en", "http://x.net/fr/1", "http://net/es/", "ftp://com/", "http://b.com?q/en/", "http://spam.org/", "http://q.net/FR/", "a://b://c.com/x"]
    spark.createDataFrame([(i, u, None if i % 3 == 0 else f"<p>t {i}</p>") for i, u in enumerate(urls * 2)], "page_id bigint, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_line_dedup", "op8_ngram_jaccard", "op9_url_filters"])
def test_sql(spark, folder, name):
    module = {"6": op6_quality_rules, "7": op7_line_dedup, "8": op8_ngram_jaccard, "9": op9_url_filters}[name[2]]
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
    wanted = con.execute(module.SQL)
    names = [x[0] for x in wanted.description]
    order = [names.index(c) for c in sorted(names)]
    made = queries()[name](spark, folder)
    assert sorted(made.columns) == sorted(names)
    assert rows(made) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in queries() if n not in ("op9_url_filters", "op10_html_extraction")])
def test_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries()[name](spark, str(tmp_path)).collect() == []


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries()["op9_url_filters"](spark, str(tmp_path)).collect() == []
    assert queries()["op10_html_extraction"](spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, docs):
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    bench = spark.createDataFrame([(1, texts()[30])], "item_id bigint, text string")
    for made in (op6_quality_rules.keep_good(odd), op8_ngram_jaccard.keep_first(odd), op1_decontaminate.drop_leaks(odd, bench)):
        assert made.columns == odd.columns
        assert all(r["row"] == 1 for r in made.collect())
    kept, out = op7_line_dedup.drop_shared_lines(odd)
    assert kept.drop(out).columns == odd.columns and kept.count() == docs.count()
    assert op3_bpe.digest(odd, vocabulary()).count() == op4_pii.digest(odd).count() == op5_secrets.digest(odd).count() == docs.count()


def test_rejected_hosts_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    bad = spark.createDataFrame([(1000 + i, "short", "en", "bad.org", 5) for i in range(40)] + [(2000, " ".join(f"w{i}" for i in range(50)), "en", "bad.org", 5)], SCHEMA)
    both = docs.union(bad)
    judged, out = op6_quality_rules.judge(both)
    want = rows(judged.filter(f"{out}.kept").drop(out))
    assert 2000 not in {r[0] for r in want} and want
    assert rows(op6_quality_rules.keep_good(both)) == want
    monkeypatch.setattr(op6_quality_rules, "BROADCAST_HOSTS", 0)
    assert rows(op6_quality_rules.keep_good(both)) == want


def test_bpe_ids(spark):
    made = op3_bpe.encode_documents(spark.createDataFrame([(1, "a bc"), (2, None), (3, "é🙂 x")], "doc_id bigint, text string"), vocabulary(), out="o").collect()
    for r in made:
        assert r["o"]["n_tokens"] == len(r["o"]["ids"]) and r["o"]["decoded"] == (r["text"] or "")
        assert r["o"]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(r['o']['ids'])}I", *r["o"]["ids"])).hexdigest()


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    more = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(["a<|endoftext|>b <|endoftext|>", "don't  stop\n\n x", "x" * 3000, "é" * 500, "123 456  \t 7"])], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(more).union(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id") + 20_000, "text"))
    made = {r["doc_id"]: r for r in op3_bpe.digest(both, vocabulary()).collect()}
    for doc_id, text in both.collect():
        ids = t.encode(text or "", add_special_tokens=False).ids
        got = made[doc_id]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def luhn(x):
    d = [int(c) for c in x[::-1]]
    return sum(d[::2] + [y // 10 + y % 10 for y in (2 * c for c in d[1::2])]) % 10 == 0


def pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


def secrets(text):
    kinds = [
        (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


def noise(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


@pytest.mark.parametrize(("operator", "brute", "kinds", "alphabet"), [
    (op4_pii, pii, op4_pii.KINDS, ["a", "b", "@", ".", "-", "1", "4", "9", "255", " ", "+", "(", ")", "4111 1111 1111 1111", "+44 20 7946 0958", "x.y@z.org", "é", "🙂", "10.0.0.1", "\n"]),
    (op5_secrets, secrets, op5_secrets.KINDS[:3], ["token", "Secret", "api_key", "APIKEY", "password", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0f", "z", "ſ", "é", "🙂", "\n", "."]),
])
def test_base_spans(spark, docs, operator, brute, kinds, alphabet):
    extra = [(50_000 + i, t, "en", f"s{i}", 1) for i, t in enumerate(noise(alphabet, 400, 3))]
    both = docs.union(spark.createDataFrame(extra, SCHEMA)).union(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 90_000))
    made = {r["doc_id"]: r for r in operator.digest(both).collect()}
    assert len(made) == both.count()
    for r in both.collect():
        spans = brute(r["text"] or "")
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        got = made[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (r["text"], said, got["spans"])
        assert [got[f"n_{k}"] for k in kinds] == [sum(kinds[x] == k for _, x, _ in spans) for k in kinds]
        assert set(filter(None, said.split(","))) <= set(got["spans"].split(","))


def test_pii_discovers_what_patterns_support(spark):
    known = [(i, f"please contact user number 10.1.2.{i} for access") for i in range(40)]
    unseen = [(100, "please contact user number 300.1.2.999 for access"), (101, "the build 1.2.3.4444 is out")]
    made = {r["doc_id"]: r for r in op4_pii.digest(spark.createDataFrame(known + unseen, "doc_id bigint, text string")).collect()}
    assert made[100]["n_ip"] == 0 and made[100]["spans"].startswith("ip:27:")
    assert made[101]["spans"] == ""


def test_secrets_ownership(spark):
    copied = [(i, 'x = "' + "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8" + '"', f"s{i}") for i in range(5)]
    live = [(10, 'x = "' + "Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2" + '"', "s1")]
    made = {r["doc_id"]: r["spans"] for r in op5_secrets.digest(spark.createDataFrame(copied + live, "doc_id bigint, text string, source string")).collect()}
    assert made[10] == "other:5:29" and all(made[i] == "" for i in range(5))


def leaks_brute(text, items):
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    w, out = words(text), set()
    for item, t in items:
        found = []
        for side in map(words, op1_decontaminate.question_and_answer(t)):
            n = min(5, len(side))
            own = grams(side, n)
            found.append(len(own & grams(w, n)) / len(own))
        if min(found) >= 0.8:
            out.add(item)
    return out


def test_decontamination(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000, None), (9001, items[0][1].upper()), (9002, "pre " * 900 + items[3][1] + " post" * 900)], "doc_id bigint, text string"))
    bench = spark.createDataFrame([*items, (500, None), (501, "...")], "item_id bigint, text string")
    made = defaultdict(set)
    for r in op1_decontaminate.leaked_pairs(docs, bench).collect():
        made[r["doc_id"]].add(r["item_id"])
    assert items[0][0] in made[9001] and items[3][0] in made[9002]
    assert {d: x for d, t in docs.collect() if (x := leaks_brute(t, items))} == dict(made)
    assert op1_decontaminate.drop_leaks(docs, bench).count() == docs.count() - len(made)


def test_block_max_wand():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, range(300, 0, -1), k=rng.randrange(3, 40)))) for i in range(300)]
    index = op1_decontaminate.Index(items, 0.3)
    for _ in range(60):
        terms = rng.sample(sorted(index.postings), 60)
        scores = defaultdict(float)
        for t in terms:
            for piece, w in zip(*index.postings[t], strict=True):
                scores[piece] += w
        assert [p for p, _ in index.retrieve(terms)] == sorted(p for p, s in scores.items() if s >= 0.3 - 1e-9)


def test_classifier_on_held_out_labels(spark):
    big = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 3 <> 0")
    made = op2_quality_classifier.score(docs, known)
    assert made.count() == docs.count()
    held = made.join(labels.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y")), "doc_id").select("quality", "y").collect()
    good, bad = ([r[0] for r in held if r["y"] == y] for y in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95


def test_classifier_without_labels(spark, docs):
    made = op2_quality_classifier.score(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).collect()
    assert len(made) == docs.count() and all(r["kept"] and r["quality"] is None for r in made)


def test_jaccard_join_of_random_near_copies(spark):
    rng = random.Random(9)
    rows, words = [], [f"v{i}" for i in range(3000)]
    for group in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((4, 20, 60, 300, 1000)))]
        for _ in range(8):
            near = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((len(rows), " ".join(near)))
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    least = {i: i for i, _ in rows}
    find = lambda x: x if least[x] == x else find(least[x])
    for a, b in combinations(grams, 2):
        if 100 * len(grams[a] & grams[b]) >= 90 * len(grams[a] | grams[b]):
            a, b = sorted((find(a), find(b)))
            least[b] = a
    made = op8_ngram_jaccard.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made} == {i: (len(grams[i]), find(i)) for i in grams}


def test_html(spark):
    page = '<html><nav>menu</nav><div class="cookie-notice">ok?</div><article><h1>A&amp;B</h1><p>one <b>two</b><br>three</p><p>x<p>y</article><div class="comments">c</div><footer>f</footer>'
    plain = "<body><p>shared menu</p><p>own {}</p><p>shared end</p>"
    rows = [(1, "http://a.org/x", page), (2, "http://b.org/p/1", plain.format(1)), (3, "http://b.org/p/2", plain.format(2)), (4, None, None), (5, "x", "")]
    made = {r["page_id"]: r for r in op10_html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert made[1]["text"] == "A&B one two three x y"
    assert (made[2]["text"], made[3]["text"], made[4]["text"], made[5]["n_chars"]) == ("own 1", "own 2", "", 0)


def test_every_page_gives_its_article(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    made = {r["page_id"]: r["text"] for r in op10_html_extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        import html

        assert made[r["page_id"]] == " ".join(html.unescape(re.sub(r"</?(?!b\b)[a-z][^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
