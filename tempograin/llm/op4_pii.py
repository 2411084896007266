"""Personal data by bootstrapped contextual extraction.

Base patterns find seed entities. Candidates are tokens around a digit or an at sign, and runs of such tokens that hold nothing but
digits and separators. The words around seeds and candidates are lexical patterns; patterns and instances form a bipartite
graph that Spark scores over ROUNDS: a pattern's confidence is the share of its distinct instances' scores, an instance's score
for a kind is a noisy-or of its confident patterns. Unseen candidates of a fitting shape with a score of ACCEPT or more
become spans of that kind; base spans always stay, and none that overlaps one is added.

Null or empty text: no spans. Empty table: empty result. Repeated rows are all returned and count once in the graph, as its
edges are distinct. Candidates may be of any length, and words of patterns are whole words. Equal scores of two kinds: both
spans. Spans are code points, end exclusive; kinds sort as in KINDS. A pattern that very many texts share is one row per distinct
instance before anything meets by pattern. Columns other than those named are left out of the digest.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_name

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENT, ACCEPT, SUPPORT = 3, 0.8, 0.9, 3
#: What an unseen instance of a fitting shape weighs in a pattern's count, against 1 of a seed or of one that doesn't fit.
UNSEEN = 0.25
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Tokens that may be identifiers: runs without white space around a digit or an at sign; tokens of digits and separators go on in the next one.
TOKEN = re.compile(r"\S+")
MARKED = re.compile(r"[0-9@]")
NUMERIC = re.compile(r"[0-9()+./-]+")
EDGE = ".,;:!?\"'()[]{}<>"
#: As EDGE, but round brackets can be the start of a number.
SIDES = EDGE.replace("(", "").replace(")", "")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign leftwards, as far as the local part and the match before allow."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def shape(token: str) -> list[int]:
    """Kinds whose looser shape a token has."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    return [0] * ("@" in token[1:-1]) + [1] * (token.count(".") == 3 and not letters and digits >= 4) + [2] * (14 <= digits <= 19 and not letters) + [3] * (7 <= digits <= 15 and not letters)


def word_before(text: str, at: int) -> tuple[int, int]:
    """(start, end) of the last whole word before a position; empty at a text's start."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    start = at
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    return start, at


def bare(word: str) -> str:
    return word.strip(EDGE).lower()


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before; the word before and the word after. None at a text's end."""
    a, b = word_before(text, start)
    one, two = bare(text[a:b]), bare(text[slice(*word_before(text, a))])
    after = TOKEN.search(text, end)
    right = bare(after[0]) if after else ""
    return ([f"{two} {one} *"] if one and two else []) + ([f"{one} * {right}"] if one and right else [])


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of tokens around a digit or an at sign, without punctuation at the edges; instead of numeric tokens apart by single spaces, their run if that has a fitting shape."""
    out, done, whole = [], 0, 0
    run: list[tuple[int, int]] = []

    def trimmed(start: int, end: int, edge: str = EDGE) -> tuple[int, int]:
        body = text[start:end]
        return start + len(body) - len(body.lstrip(edge)), start + len(body.rstrip(edge))

    def close() -> None:
        nonlocal whole
        if len(run) > 1:
            s, e = trimmed(run[0][0], run[-1][1], SIDES)
            if shape(text[s:e]):
                # its tokens are the latest ones
                while len(out) > whole and out[-1][0] >= s:
                    out.pop()
                out.append((s, e))
                whole = len(out)
        run.clear()

    for m in MARKED.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = TOKEN.match(text, start).end()
        if run and text[run[-1][1] : start] != " ":
            close()
        out.append(trimmed(start, done))
        # a comma or stop ends a run
        core = trimmed(start, done, SIDES)
        if NUMERIC.fullmatch(text, *core):
            if core[0] > start and run:
                out.pop()
                close()
                out.append(trimmed(start, done))
            run.append(core)
            if core[1] < done:
                close()
        elif run:
            out.pop()
            close()
            out.append(trimmed(start, done))
    close()
    return out


def found_in(text: str) -> dict:
    base = base_spans(text)
    rows = [{"kind": k, "start": s, "end": e, "value": text[s:e], "shapes": [k], "patterns": contexts(text, s, e)} for s, k, e in base]
    taken, i = sorted((s, e) for s, _, e in base), 0
    for s, e in candidates(text):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        overlaps, j = False, i
        while not overlaps and j < len(taken) and taken[j][0] < e:
            overlaps, j = taken[j][1] > s, j + 1
        if overlaps or not (kinds := shape(text[s:e])) or not (near := contexts(text, s, e)):
            continue
        rows.append({"kind": -1, "start": s, "end": e, "value": text[s:e], "shapes": kinds, "patterns": near})
    return {"base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "seen": rows}


_SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("shapes", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])
_FOUND = pa.struct([("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("seen", pa.list_(_SEEN))])


FOUND = "struct<base:array<struct<start:int,kind:int,end:int>>,seen:array<struct<kind:int,start:int,end:int,value:string,shapes:array<int>,patterns:array<string>>>>"


def _find(texts: pa.Array) -> pa.Array:
    return pa.array([found_in(x.as_py() or "") for x in texts], _FOUND)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns keep of docs, row, base and seen, written to the checkpoint folder."""
    p = own_name(docs, "found")
    out = docs.select(*(F.col(f"`{c}`") for c in keep), F.monotonically_increasing_id().alias("row"), F.arrow_udf(_find, FOUND)(F.col(f"`{text}`")).alias(p))
    return checkpoint(out.select(*(F.col(f"`{c}`") for c in keep), "row", f"{p}.base", f"{p}.seen"))


def discover(scanned: DataFrame) -> DataFrame:
    """value, kind, score of unseen identifiers that the pattern graph supports."""
    seen = scanned.select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.shapes", "s.patterns")
    edges = checkpoint(seen.select("kind", "value", "shapes", F.explode("patterns").alias("pattern")).distinct())
    known = edges.filter("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    links = edges.select("pattern", "value").distinct()
    fits = edges.filter("kind < 0").select("value", F.explode("shapes").alias("kind")).distinct()
    # for each pattern its instances, and for each kind those that are unseen and fit it
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    open_ = links.join(fits, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n_open"))
    scores = known
    for _ in range(ROUNDS):
        held = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("support"))
        weight = F.col("n") - (1 - UNSEEN) * F.coalesce("n_open", F.lit(0)) + 0.5
        rated = held.join(sizes, "pattern").join(open_, ["pattern", "kind"], "left").withColumn("confidence", F.least(F.col("sum") / F.greatest(weight, "sum"), F.lit(1.0)))
        confident = rated.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT))
        reached = links.join(confident.select("pattern", "kind", "confidence"), "pattern").join(fits, ["value", "kind"], "left_semi")
        unseen = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))).alias("score"))
        scores = checkpoint(known.union(unseen))
    return scores.join(known, ["value", "kind"], "left_anti").filter(F.col("score") >= ACCEPT)


def in_words(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_spans."""
    scanned = scan(docs.select("doc_id", "text"))
    tokens = scanned.select("row", F.explode(F.filter("seen", lambda s: s["kind"] < 0)).alias("s")).select("row", "s.start", "s.end", "s.value")
    more = tokens.join(discover(scanned), "value").groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    rows = scanned.join(more, "row", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    n_of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(n_of, KINDS), F.sha2(in_words(F.col("base")), 256).alias("base_sha256"), in_words(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_discovered"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))
