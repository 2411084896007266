"""URL filters by a bit-parallel wildcard automaton.

Glob rules ("?" any character, "*" any run, a backslash before a character for itself) are packed one after another into Shift-And masks of 64-bit words. All
patterns advance together, one character of every URL of a batch at a time. A canonical URL is a dot, the host, an end
mark, and the path, so that the glob ".example.com" after "*" fits the host and its subdomains only.

Null url, or one without "://": host and path are empty, no rule fits, and the verdict is allow. A rule fits if the
path starts with the rule's path; the longest rule wins, block before allow at a tie. Where none fits, default globs
over the canonical URL decide: block if one fits, else allow. A NUL in a url is an ordinary character; a rule can't have one.
Repeated rows and extra columns stay as they are; an empty table gives an empty result; urls may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name

MARK = "\x00"

#: (action, rule): rule is a host, then a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs of hosts that sell or farm links, for URLs that no rule fits.
DEFAULT_BLOCKS = ("*spam*" + MARK + "*", "*cheap-*" + MARK + "*", "*casino*" + MARK + "*")


def host_and_path(url: str | None) -> tuple[str, str]:
    rest = url.partition("://")[2] if url else ""
    if not rest:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: slash if slash >= 0 else end]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[slash:end] if slash >= 0 else ""


#: Stands for a NUL in a url; as half of a pair it is in no rule.
NUL = "\ud800"


def rule_glob(rule: str) -> str:
    if MARK in rule or NUL in rule:
        raise ValueError(f"a rule can't have that character: {rule!r}")
    host, slash, path = rule.partition("/")
    escaped = "".join(f"\\{c}" if c in "\\*?" else c for c in f".{host.lower()}{MARK}{slash}{path}")
    return f"*{escaped}*"


def canonical(host: str, path: str) -> str:
    return f".{host.replace(MARK, NUL)}{MARK}{path.replace(MARK, NUL)}" if host or path else ""


class Automaton:
    """Shift-And over many globs. Each glob of m literals owns m + 1 bits; bit j says that j literals are matched."""

    def __init__(self, globs: list[str]):
        start, loops, any_char, by_char, ends, bit = [], [], [], {}, [], 0
        for glob in globs:
            start.append(bit)
            rest = iter(glob)
            for c in rest:
                if c == "*":
                    loops.append(bit)
                    continue
                bit += 1
                # an escaped character stands for itself
                (any_char if c == "?" else by_char.setdefault(next(rest, c) if c == "\\" else c, [])).append(bit)
            ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.loops = self._mask(start), self._mask(loops)
        self.ends = [(e // 64, np.uint64(e % 64)) for e in ends]
        self.alphabet = np.array(sorted(map(ord, by_char)), np.uint32)
        self.table = np.stack([self._mask(any_char + by_char[chr(c)]) for c in self.alphabet] + [self._mask(any_char)])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """A row for each text and a column for each glob: whether it fits the whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.start, (len(texts), 1))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(0, len(self.alphabet) - 1))
        kind = np.where(self.alphabet[at] == codes, at, len(self.alphabet)) if len(self.alphabet) else np.zeros(len(codes), np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for step, n in enumerate(alive):
            rows = order[:n]
            now = state[rows]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[rows] = (moved & self.table[kind[first[rows] + step]]) | (now & self.loops)
        return np.stack([(state[:, w] >> b) & one for w, b in self.ends], 1).astype(bool) if len(self.ends) else np.zeros((len(texts), 0), bool)


def judge_urls(pages: DataFrame, rules=RULES, default_blocks=DEFAULT_BLOCKS, url: str = "url", out: str = "judged") -> DataFrame:
    """pages with a column out: struct of host, path, rule, verdict."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))

    @F.arrow_udf("struct<host:string,path:string,rule:string,verdict:string>")
    def judge(urls: pa.Array) -> pa.Array:
        automaton = Automaton([rule_glob(r) for _, r in ranked] + list(default_blocks))
        parts = [host_and_path(u.as_py()) for u in urls]
        fits = automaton.matches([canonical(h, p) for h, p in parts])
        ruled = fits[:, : len(ranked)]
        best = np.where(ruled.any(1), ruled.argmax(1), -1) if len(ranked) else np.full(len(parts), -1)
        spam = fits[:, len(ranked) :].any(1)
        return pa.array(
            [{"host": h, "path": p, "rule": ranked[b][1] if b >= 0 else None, "verdict": ranked[b][0] if b >= 0 else "block" if s else "allow"} for (h, p), b, s in zip(parts, best, spam, strict=True)],
            pa.struct([(x, pa.string()) for x in ("host", "path", "rule", "verdict")]),
        )

    return pages.withColumn(out, judge(F.col(f"`{url}`")))


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    out = own_name(pages, "judged")
    return judge_urls(pages.select("page_id", "url"), out=out).select("page_id", f"{out}.*")


SQL = r"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut as (
  select page_id, regexp_extract(rest, '^([^?#]*)', 1) as kept from parts),
split as (
  select page_id, translate(regexp_extract(kept, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when contains(kept, '/') then substr(kept, strpos(kept, '/')) else '' end as path from cut),
rules(action, rule, rule_host, rule_path) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit as (
  select page_id, host, path, (select max_by(struct_pack(action := action, rule := rule), length(rule)) from rules
    where ends_with('.' || host, '.' || rule_host) and starts_with(path, rule_path)) as best from split)
select page_id, host, path, best.rule as rule,
  coalesce(best.action, case when contains(host, 'spam') or contains(host, 'cheap-') or contains(host, 'casino') then 'block' else 'allow' end) as verdict
from fit
"""
