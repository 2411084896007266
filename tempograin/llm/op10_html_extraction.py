"""Main text of web pages, by differencing each page against its nearest neighbour by URL, and by markup roles.

Pages of a host are sorted by path; each page is paired with the neighbour whose path has the longest common start. Pages of
a host with the same lines count as one, at their least path, so a page is never paired with its own copy. Blocks of text are
the lines; the longest common subsequence of both pages' lines is boilerplate and goes, except for lines that are inside
the article or main element of both pages; other lines stay. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments go by their elements, roles and class names. A page without neighbour gives its article, else its
main element, else all lines.

Null or empty html: empty text. Pages without a host have no neighbour. Sorting is by ranges, so no task gets a whole host;
the edge rows of each range meet those of the next one by host. Repeated rows are all returned. Truncated markup is closed at its end.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .op9_url_filters import host_and_path

RAW = "script|style|noscript|template|textarea|select|svg|iframe|object|canvas|math|title"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<({RAW})(?=[\s/>])(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice banner popup modal overlay sidebar sidenav "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus share sharing social newsletter subscribe signup related recommended".split()
)
HEADERS = frozenset("header masthead topbar site-header page-header".split())
NAMED = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|(?=[\s/]|$))""", re.I)


def role_of(tag: str, attributes: str, inside: bool) -> str:
    """drop, article, main or nothing. inside: within an article or main element, where a header is part of it."""
    if tag in DROPPED or tag == "header" and not inside:
        return "drop"
    role = "article" if tag == "article" else "main" if tag == "main" else ""
    if attributes and tag not in ("html", "body"):
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "role" and value in ROLES:
                return "drop"
            if name in ("class", "id"):
                for word in value.split():
                    ends = re.split(r"[-_]+", word)
                    if word in NAMES or ends[0] in NAMES or ends[-1] in NAMES or word in HEADERS and not inside:
                        return "drop"
            if name == "role" and value == "main":
                role = role or "main"
            if name == "itemprop" and value == "articlebody":
                role = role or "article"
    return role


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of each block that markup doesn't rule out, in page order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    at, buffer, role = 0, [], ""

    def flush() -> None:
        if buffer:
            words = entities.unescape("".join(buffer)).split()
            buffer.clear()
            if words and role != "drop":
                out.append((role, " ".join(words)))

    page = page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        closing, tag = m[2], (m[3] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if any(r != role for _, r in stack[:depth][-1:] or [("", "")]):
                    flush()
                del stack[depth:]
                role = stack[-1][1] if stack else ""
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag == "p":  # a paragraph ends where the next one starts
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
                role = stack[-1][1] if stack else ""
            own = role if role == "drop" else role_of(tag, m[4], role in ("article", "main")) or role
            if role == "article" and own == "main":
                own = "article"
            if own != role:
                flush()
                role = own
            stack.append((tag, own))
    buffer.append(page[at:] if at < len(page) and not page[at:].startswith("<") else "")
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Positions in a of a longest common subsequence of a and b: the longest rising run over the matching pairs."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails, ends, links = [], [], []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect.bisect_left(tails, j)
            link = (i, ends[k - 1] if k else -1)
            links.append(link)
            if k == len(tails):
                tails.append(j)
                ends.append(len(links) - 1)
            else:
                tails[k], ends[k] = j, len(links) - 1
    out, at = set(), ends[-1] if ends else -1
    while at >= 0:
        i, at = links[at]
        out.add(i)
    return out


def marks_of(lines: list[int], neighbour: dict | None) -> bytes | None:
    """Of each line: 0 if it is the page's own, 1 if the neighbour has it as content too, 2 if it is boilerplate. None without a neighbour."""
    if neighbour is None:
        return None
    shared = common_lines(lines, neighbour["lines"])
    content = {x for x, inside in zip(neighbour["lines"], neighbour["content"], strict=True) if inside}
    return bytes(0 if i not in shared else 1 if x in content else 2 for i, x in enumerate(lines))


def line_hashes(blocks: list[tuple[str, str]]) -> list[bytes]:
    return [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for _, t in blocks]


def best_role(roles: list[str]) -> str:
    return "article" if "article" in roles else "main" if "main" in roles else ""


def main_text(roles: list[str], lines: list[str], marks: bytes | None) -> str:
    best = best_role(roles)
    if marks is None:
        return " ".join(t for r, t in zip(roles, lines, strict=True) if r == best)
    return " ".join(t for r, t, m in zip(roles, lines, marks, strict=True) if m == 0 or m == 1 and best and r == best)


def nearest(one: dict, others: list[dict | None]) -> dict | None:
    """Of others, which are of the same host or None, the one whose path has the longest common start with one's."""
    return max((x for x in others if x), key=lambda x: len(os.path.commonprefix([one["path"], x["path"]])), default=None)


PAGE = "path:string,lines:array<bigint>,content:binary"
_PAGE = [("path", pa.string()), ("lines", pa.list_(pa.int64())), ("content", pa.binary())]
_MARKED = pa.schema([("host", pa.string()), ("key", pa.binary()), ("marks", pa.binary()), ("at", pa.int64()), ("own", pa.struct(_PAGE)), ("before", pa.struct(_PAGE)), ("after", pa.struct(_PAGE))])
MARKED = f"host string, key binary, marks binary, at long, own struct<{PAGE}>, before struct<{PAGE}>, after struct<{PAGE}>"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of pages; a page waits for the next one. The first and last rows of the range go out with what they know of their neighbours."""
    before = now = None
    at = 0

    def done(after: dict | None, edge: bool) -> dict:
        beside = [x["own"] if x and x["host"] == now["host"] else None for x in (before, after)]
        row = {"host": now["host"], "key": now["key"]}
        return row | ({"at": at, "own": now["own"], "before": beside[0], "after": beside[1]} if edge else {"marks": marks_of(now["own"]["lines"], nearest(now["own"], beside)) or b""})

    for batch in batches:
        rows = []
        for after in batch.to_pylist():
            if now is not None:
                rows.append(done(after, before is None))
                at += 1
            before, now = now, after
        yield pa.RecordBatch.from_pylist(rows, _MARKED)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done(None, True)], _MARKED)


def _mark_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("key", pa.binary()), ("marks", pa.binary())])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{"host": r["host"], "key": r["key"], "marks": marks_of(r["own"]["lines"], nearest(r["own"], [r["before"], r["after"]])) or b""} for r in batch.to_pylist()], schema)


def marked(cut: DataFrame) -> DataFrame:
    """host, key, marks of each distinct page of a host; empty marks if it is the host's only one. Only hashes of lines move. cut: host, key, path, hashes, content."""
    own = F.struct("path", F.col("hashes").alias("lines"), "content")
    pages = cut.filter("host <> '' and size(hashes) > 0").groupBy("host", "key").agg(F.min(own).alias("own"))
    by = ("host", "own.path", "key")
    ranged = pages.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_mark, MARKED)
    found = checkpoint(ranged.withColumn("part", F.spark_partition_id()))
    # an edge row's missing neighbour is the edge row of its host in the ranges beside
    order = Window.partitionBy("host").orderBy("part", "at")
    edges = found.filter("marks is null").select("host", "key", "own", F.coalesce("before", F.lag("own").over(order)).alias("before"), F.coalesce("after", F.lead("own").over(order)).alias("after"))
    return found.filter("marks is not null").select("host", "key", "marks").union(edges.mapInArrow(_mark_edges, "host string, key binary, marks binary"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    text = pa.list_(pa.string())

    @F.arrow_udf("struct<key:binary,hashes:array<bigint>,content:binary>")
    def digests(htmls: pa.Array) -> pa.Array:
        out = []
        for x in htmls:
            found = blocks_of(x.as_py())
            best = best_role([r for r, _ in found])
            hashes = line_hashes(found)
            out.append({"key": hashlib.md5(b"".join(hashes)).digest(), "hashes": [int.from_bytes(h, "little", signed=True) for h in hashes], "content": bytes(best != "" and r == best for r, _ in found)})
        return pa.array(out, pa.struct([("key", pa.binary()), ("hashes", pa.list_(pa.int64())), ("content", pa.binary())]))

    @F.arrow_udf("struct<key:binary,roles:array<string>,lines:array<string>>")
    def parse(htmls: pa.Array) -> pa.Array:
        out = []
        for x in htmls:
            found = blocks_of(x.as_py())
            out.append({"key": hashlib.md5(b"".join(line_hashes(found))).digest(), "roles": [r for r, _ in found], "lines": [t for _, t in found]})
        return pa.array(out, pa.struct([("key", pa.binary()), ("roles", text), ("lines", text)]))

    @F.arrow_udf("struct<host:string,path:string>")
    def parts(urls: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("host", "path"), host_and_path(u.as_py()), strict=True)) for u in urls], pa.struct([("host", pa.string()), ("path", pa.string())]))

    @F.arrow_udf("string")
    def choose(roles: pa.Array, lines: pa.Array, marks: pa.Array) -> pa.Array:
        return pa.array([main_text(r, t, m or None) for r, t, m in zip(roles.to_pylist(), lines.to_pylist(), marks.to_pylist(), strict=True)], pa.string())

    cut = pages.select(digests("html").alias("b"), parts("url").alias("p")).select("p.host", "p.path", "b.*")
    whole = pages.select(F.col("page_id").cast("long"), "url", parse("html").alias("b"), parts("url").alias("p")).select("page_id", "url", "p.host", "b.*")
    joined = whole.join(marked(cut), ["host", "key"], "left")
    return joined.select("page_id", "url", choose("roles", "lines", "marks").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
