"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols; decoding by joining vocabulary strings.

A text is cut at the added tokens' strings, then into pieces by the pre-tokenizer's pattern; each piece is merged by
rank. A task keeps the merged pieces it met last, up to PIECES_KEPT of them, so a frequent piece is merged once.

Null text: as an empty one, no ids. Repeated rows and extra columns stay as they are. A long piece costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_KEPT = 400_000
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_characters()
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.single[byte_of[token]] = i
        self.strings = {i: raw(token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: token.encode() for token, i in self.added.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kept: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. An entry of the queue is stale if a symbol of its pair was merged since."""
        symbol = [self.single[x] for x in piece]
        n, ranks = len(symbol), self.ranks
        after, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := ranks.get((symbol[i], symbol[j]))):
                heapq.heappush(queue, (found[0], i, symbol[i], symbol[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in symbol if x >= 0]

    def packed(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        found = b"".join(x.to_bytes(4, "little") for x in ids)
        if len(piece) <= 64:
            if len(self.kept) >= PIECES_KEPT:
                self.kept.clear()
            self.kept[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        out, kept = [], self.kept
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                for piece in self.pieces(part):
                    out.append(kept.get(piece) or self.packed(piece))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I") if packed else ()
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One Codec for each Python worker and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "bpe", ids: bool = True, decoded: bool = True) -> DataFrame:
    """docs with a column out: struct of n_tokens, ids_sha256, decoded_sha256, and ids and decoded text if asked for."""
    kind = DIGEST.replace(", ", ",").replace(" ", ":") + ",ids:array<int>" * ids + ",decoded:string" * decoded

    @F.arrow_udf(f"struct<{kind}>")
    def encode(texts: pa.Array) -> pa.Array:
        known, counts, digests, packs, strings = codec(vocabulary), [], ([], []), [], []
        for x in texts:
            packed = known.encode(x.as_py() or "")
            string = known.decode(packed)
            counts.append(len(packed) // 4)
            digests[0].append(hashlib.sha256(packed).hexdigest())
            digests[1].append(hashlib.sha256(string.encode()).hexdigest())
            # ids stay packed: as Python integers, those of a batch would take ten times the memory
            packs += [packed] * ids
            strings += [string] * decoded
        columns = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests[0], pa.string()), "decoded_sha256": pa.array(digests[1], pa.string())}
        if ids:
            ends = pa.array(np.cumsum([0, *counts]), pa.int32())
            columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packs), "<i4")))
        if decoded:
            columns["decoded"] = pa.array(strings, pa.string())
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return docs.withColumn(out, encode(F.col(f"`{text}`")))


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    out = own_name(docs, "bpe")
    coded = encode_documents(docs.select("doc_id", "text"), vocabulary, out=out, ids=False, decoded=False)
    return coded.select("doc_id", f"{out}.*")
