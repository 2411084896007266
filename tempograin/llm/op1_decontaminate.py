"""Benchmark decontamination: BM25 over an inverted index of test items, read by block-max WAND for every passage of every text.

The index holds pieces of items, up to PIECE_WORDS words each. Weights are BM25's, divided by the piece's sum, so that a passage
with all words of a piece scores 1. Every document is cut into overlapping passages, twice as long as a piece, and
each passage retrieves all pieces that score SCORE or more. Terms are split so that no passage can reach SCORE without
SCORE - FREQUENT_SHARE from a piece's rarer words; passages that lack these (the usual case) are passed over in bulk, the
rest go through block-max WAND. Retrieved items are verified by five-word shingles of question and answer, which have to be in
the passages that retrieved the item: a text that has both, but too far apart for that, isn't a leak.

Only the test set is broadcast, in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters. Of more than one block, each
is read, broadcast and released before the next one, and makes a pass over the texts. Rows of the test set stand for themselves: each
text of a repeated item_id is searched for, and so are those of a null item_id; a text and an item_id make one leak, the best scored.
An item's answer is its last sentence, its question the rest. Null or wordless text: no leak. Items without words match nothing. Repeated
rows are judged alike; extra columns stay as they are. Letter case and ASCII punctuation don't count.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_name, written
from .hashing import PUNCTUATION, ngrams, word_hashes

K1, B = 1.2, 0.75
SCORE, FREQUENT_SHARE = 0.6, 0.35
OVERLAP, SHINGLE = 0.8, 5
PIECE_WORDS = 128
POSTING_BLOCK = 32
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass"), PUNCTUATION)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence (after a line end, or a stop and a space) is the answer; of a text without such a cut, both are the whole."""
    cuts = [m.end() for m in re.finditer(r"[.?!]\s+|\n", text.rstrip())]
    cut = next((c for c in reversed(cuts) if len(words_of(text[c:])) and len(words_of(text[:c]))), None)
    return (text[:cut], text[cut:]) if cut else (text, text)


class Index:
    """Postings of a block of items, with the maximal weight of each term and of each posting block."""

    def __init__(self, items: list[tuple[int | None, str]], score: float = SCORE):
        # pieces belong to rows, as an item_id may be repeated or null
        self.score, self.ids, self.row, self.sides, bags = score, [i for i, _ in items], [], [], []
        for row, (_, text) in enumerate(items):
            q, a = question_and_answer(text or "")
            self.sides.append((words_of(q), words_of(a)))
            words = words_of(text)
            for at in range(0, len(words), PIECE_WORDS):
                self.row.append(row)
                bags.append(Counter(words[at : at + PIECE_WORDS].tolist()))
        df = Counter(t for bag in bags for t in bag)
        mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
        self.postings: dict[int, tuple[list[int], list[float]]] = {}
        rest = [FREQUENT_SHARE] * len(bags)
        weights = []
        for bag in bags:
            length = sum(bag.values())
            w = {t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in bag.items()}
            total = sum(w.values())
            weights.append({t: x / total for t, x in w.items()})
        for piece, bag in enumerate(weights):
            for t, x in bag.items():
                self.postings.setdefault(t, ([], []))[0].append(piece)
                self.postings[t][1].append(x)
        rare = []
        for t in sorted(df, key=lambda t: (-df[t], t)):
            pieces, ws = self.postings[t]
            if all(rest[p] >= x for p, x in zip(pieces, ws, strict=True)):
                for p, x in zip(pieces, ws, strict=True):
                    rest[p] -= x
            else:
                rare.append(t)
        self.least = score - FREQUENT_SHARE
        self.top = {t: max(ws) for t, (_, ws) in self.postings.items()}
        self.block_top = {t: [max(ws[i : i + POSTING_BLOCK]) for i in range(0, len(ws), POSTING_BLOCK)] for t, (_, ws) in self.postings.items()}
        # the rare terms' postings, flat, for looking at a whole document at once
        self.rare = np.array(sorted(rare), np.uint64)
        lists = [self.postings[t] for t in self.rare.tolist()]
        self.rare_start = np.concatenate(([0], np.cumsum([len(p) for p, _ in lists]))).astype(np.int64)
        self.rare_piece = np.array([p for ps, _ in lists for p in ps], np.int64)
        self.rare_weight = np.array([w for _, ws in lists for w in ws])
        # a table over the low bits of the hashes says at once that most words aren't rare terms
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.rare & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def passages(self, words: np.ndarray) -> list[int]:
        """Starts of the passages in which some piece has enough of its rare words; a passage starts at each multiple of PIECE_WORDS."""
        if not len(self.rare):
            return []
        at = np.flatnonzero(self.seen[(words & np.uint64((1 << 18) - 1)).astype(np.int64)])
        term = np.searchsorted(self.rare, words[at])
        hit = self.rare[np.minimum(term, len(self.rare) - 1)] == words[at]
        at, term = at[hit], term[hit]
        n = self.rare_start[term + 1] - self.rare_start[term]
        flat = np.repeat(self.rare_start[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        piece, block, which = self.rare_piece[flat], np.repeat(at // PIECE_WORDS, n), np.repeat(term, n)
        # a block of words belongs to the passage that starts there and to the one before
        piece, which, weight = np.tile(piece, 2), np.tile(which, 2), np.tile(self.rare_weight[flat], 2)
        block = np.concatenate((block, np.maximum(block - 1, 0)))
        order = np.lexsort((which, piece, block))
        piece, which, weight, block = piece[order], which[order], weight[order], block[order]
        if not len(block):
            return []
        new_pair = np.concatenate(([True], (block[1:] != block[:-1]) | (piece[1:] != piece[:-1])))
        new_term = new_pair | np.concatenate(([True], which[1:] != which[:-1]))
        sums = np.add.reduceat(np.where(new_term, weight, 0.0), np.flatnonzero(new_pair))
        return np.unique(block[new_pair][sums >= self.least - 1e-9]).tolist()

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (piece, score) of every piece whose terms among these weigh score or more."""
        lists = [[0, *self.postings[t], self.top[t], self.block_top[t]] for t in terms if t in self.postings]
        out = []
        while lists := [x for x in lists if x[0] < len(x[1])]:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[3]
                if bound >= self.score - 1e-9:
                    pivot = x[1][x[0]]
                    last = max(j for j, y in enumerate(lists) if y[1][y[0]] <= pivot) if i + 1 < len(lists) else i
                    break
            if pivot < 0:
                break
            upto = lists[: last + 1]
            # block maxima of the lists up to the pivot, at the blocks where the pivot would be
            spots = [bisect.bisect_left(x[1], pivot, x[0]) // POSTING_BLOCK for x in upto]
            shallow = sum(x[4][s] if s < len(x[4]) else 0.0 for x, s in zip(upto, spots, strict=True))
            if shallow < self.score - 1e-9:
                ends = [x[1][min((s + 1) * POSTING_BLOCK, len(x[1])) - 1] + 1 for x, s in zip(upto, spots, strict=True) if s < len(x[4])]
                beyond = [lists[last + 1][1][lists[last + 1][0]]] if last + 1 < len(lists) else []
                target = max(pivot + 1, min([*ends, *beyond], default=pivot + 1))
            elif upto[0][1][upto[0][0]] == pivot:
                total = sum(x[2][x[0]] for x in upto)
                if total >= self.score - 1e-9:
                    out.append((pivot, total))
                target = pivot + 1
            else:
                target = pivot
            for x in upto:
                x[0] = bisect.bisect_left(x[1], target, x[0])
        return out

    def leaks(self, text: str | None) -> list[dict]:
        words = words_of(text)
        best: dict[int, float] = {}
        where: dict[int, list[int]] = {}
        for block in self.passages(words):
            terms = np.unique(words[block * PIECE_WORDS : (block + 2) * PIECE_WORDS]).tolist()
            for piece, score in self.retrieve(terms):
                row = self.row[piece]
                best[row] = max(best.get(row, 0.0), score)
                if where.setdefault(row, [block])[-1] != block:
                    where[row].append(block)
        out = {}

        def overlap(side: np.ndarray, spans: list[list[int]]) -> float:
            n = min(SHINGLE, len(side))
            own = np.unique(ngrams(side, n))
            return float(np.isin(own, np.concatenate([ngrams(words[a:b], n) for a, b in spans])).mean())

        for row in sorted(best):
            spans: list[list[int]] = []
            for block in where[row]:
                # a passage has two blocks of words; those that meet are one span
                if spans and block * PIECE_WORDS <= spans[-1][1]:
                    spans[-1][1] = (block + 2) * PIECE_WORDS
                else:
                    spans.append([block * PIECE_WORDS, (block + 2) * PIECE_WORDS])
            q, a = (overlap(side, spans) for side in self.sides[row])
            item = self.ids[row]
            if q >= OVERLAP and a >= OVERLAP and (item not in out or best[row] > out[item]["score"]):
                out[item] = {"item_id": item, "score": best[row], "question_overlap": q, "answer_overlap": a}
        return list(out.values())


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks within the stated bounds; an item longer than a block is a block of its own."""
    block, chars = [], 0
    for i, t in benchmark.filter(F.col(text).isNotNull()).select(item, text).distinct().orderBy(item, text).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(t) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((i, t))
        chars += len(t)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: array of the items that each text leaks."""
    out, context = own_name(docs, "leaks"), docs.sparkSession.sparkContext
    none = F.array().cast(LEAKS)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def in_block(shared):
        @F.arrow_udf(LEAKS)
        def leaks(texts: pa.Array) -> pa.Array:
            index = index_of(shared)
            return pa.array([index.leaks(x.as_py()) for x in texts], kind)

        return leaks(F.col(f"`{text}`"))

    rest = blocks(benchmark)
    ahead = list(itertools.islice(rest, 2))
    if len(ahead) < 2:
        return docs.withColumn(out, in_block(context.broadcast(ahead[0])) if ahead else none), out
    row = own_name(docs, "row")
    kept, found = written(docs.withColumn(row, F.monotonically_increasing_id())), []
    while block := ahead.pop(0) if ahead else next(rest, None):
        shared = context.broadcast(block)
        found.append(checkpoint(kept.select(F.col(f"`{row}`").alias("row"), F.explode(in_block(shared)).alias("leak"))))
        shared.destroy()
    each = reduce(DataFrame.union, found).groupBy("row", "leak.item_id").agg(F.max_by("leak", "leak.score").alias("leak"))
    leaks = each.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list("leak")).alias(out))
    return kept.join(leaks, row, "left").withColumn(out, F.coalesce(F.col(f"`{out}`"), none)).drop(row), out


_indexes: dict[int, Index] = {}


def index_of(shared) -> Index:
    """One Index for each Python worker and broadcast block; the two latest are kept."""
    key = hash(tuple(shared.value))
    if key not in _indexes:
        while len(_indexes) > 1:
            _indexes.pop(next(iter(_indexes)))
        _indexes[key] = Index(shared.value)
    return _indexes[key]


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each verified leak."""
    found, out = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode(out).alias("leak")).select("doc_id", "leak.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item."""
    found, out = find_leaks(docs, benchmark)
    return found.filter(F.size(out) == 0).drop(out)
