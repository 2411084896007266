"""Similarity join of documents by Jaccard similarity of word n-grams.

Equal sets are collapsed first, so that copies cost one row. Distinct sets meet in tiles. A tile is a run of TUPLE or fewer
n-grams that follow each other in a set's order by hash (the last one is followed by the first). Each n-gram that only one of
two sets has breaks less than TUPLE runs, so similar sets have a fixed share of their runs in common; of these, runs whose hash is
under a limit are taken, which falls with the size of the set. So each set has some dozens of tiles whatever its size, and the
chance that similar sets meet in none is below exp(-SURE). Sets too small for any other set to be similar have none.

In a tile, members are first held against its most central member (the one that shares most tiles); those links make
components. Then only members of different components of a tile are compared: in a large tile by size bands, neighbouring bands
only, in blocks of BLOCK members. Pairs of either kind are held against hashed bitmaps, whose bit counts bound the overlap from
above; only pairs within the bound fetch their n-grams, for the exact intersection of sorted arrays. So a large group of near
copies never makes all its pairs.

Null or empty texts, or those without words: an empty set, on no link. Texts of fewer words than n: the whole sequence is the
one n-gram. Repeated rows are in one component. Null doc_id: takes part; component_id is the least doc_id that isn't null.
An empty table gives an empty result; extra columns stay as they are. n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, may_be_in, own_name, written
from .components import components
from .hashing import mix, shingle_set, word_hashes

WORDS, PERCENT = 3, 90
#: n-grams of a tile at most; exp(-SURE) bounds the chance that two similar sets share no tile.
TUPLE, SURE = 4, 30
BITMAP_WORDS = 32
#: Members of a tile that one task compares at a time; a larger tile is cut into such blocks, and each pair of blocks is a group of its own.
BLOCK = 1024


def tuple_size(percent: int) -> int:
    """n-grams of a tile: as many as leave similar sets two fifths of their runs in common."""
    return max(1, min(TUPLE, (percent - 40) // (100 - percent) + 1)) if percent < 100 else TUPLE


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of one set, given as sorted distinct hashes.

    Sets x, y with o n-grams in common and d in only one have at least o - (w - 1) d runs of w in common. With
    o >= t (|x| + |y|) / (1 + t) that is at least share * the larger size. A larger set has the lower limit.
    """
    n, w = len(grams), tuple_size(percent)
    if n * (100 - percent) < percent:  # one n-gram more or less is too much already
        return np.zeros(0, np.uint64)
    runs = mix(grams)
    for k in range(1, w):
        runs = mix(runs + np.roll(grams, -k))
    share = (percent - (w - 1) * (100 - percent)) / 100
    taken = SURE / (share * n)
    return np.unique(runs if taken >= 1 else runs[runs < np.uint64(int(taken * 2.0**64))])


def grams_of(text: str | None, words: int) -> np.ndarray:
    return shingle_set(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), words)


def bitmap_of(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_WORDS * 64, bool)
    bits[(grams >> np.uint64(7)) % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.int64)


def _profile(words: int, percent: int):
    @F.arrow_udf("struct<n:bigint,set:binary,bits:array<bigint>,tiles:array<bigint>>")
    def profile(texts: pa.Array) -> pa.Array:
        n, keys, bits, tiles, ends = [], [], [], [], [0]
        for x in texts:
            grams = grams_of(x.as_py(), words)
            n.append(len(grams))
            keys.append(hashlib.md5(grams.tobytes()).digest() if len(grams) else None)
            tiles.append(signatures(grams, percent).view(np.int64))
            bits.append(bitmap_of(grams) if len(tiles[-1]) else np.zeros(0, np.int64))
            ends.append(ends[-1] + len(tiles[-1]))
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        edges = pa.array(np.cumsum([0, *map(len, bits)]), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, flat(bits)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat(tiles))]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *lists], ["n", "set", "bits", "tiles"])

    return profile


def _grams(words: int):
    @F.arrow_udf("array<bigint>")
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([grams_of(x.as_py(), words).view(np.int64) for x in texts], pa.list_(pa.int64()))

    return grams


def _enough(common: Column, both: Column, percent: int) -> Column:
    return 100 * common >= percent * (both - common)


def _within_bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose bitmaps allow the similarity. Written, as several plans start from it."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    both = F.col("a_n") + F.col("b_n")
    common = F.least(F.floor((both - apart) / 2), "a_n", "b_n")
    return checkpoint(pairs.join(side("b"), "b").join(side("a"), "a").filter(_enough(common, both, percent)).select("a", "b"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among the pairs, by exact intersection. Only texts of nodes in pairs within the bitmap bound move. texts: content_key, text."""
    near = _within_bound(pairs, nodes, percent)
    involved = checkpoint(near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(nodes.select("node", "content_key"), "node"))
    moved = may_be_in(texts, F.col("content_key"), involved.select("content_key"), "asked").filter("asked").drop("asked")
    found = moved.join(involved, "content_key").dropDuplicates(["content_key"])
    sets = checkpoint(found.select("node", _grams(words)("text").alias("grams")))
    side = lambda k: sets.select(F.col("node").alias(k), F.col("grams").alias(f"{k}_grams"))
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    # b's n-grams meet first: a may be the centre of very many pairs
    met = near.join(side("b"), "b").join(side("a"), "a")
    return met.filter(_enough(common, F.size("a_grams") + F.size("b_grams"), percent)).select("a", "b")


def _near_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different parts of a tile whose bitmaps allow the similarity. members: tile, size, node, part, n, bits."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # sets whose sizes are similar enough are in one band or in neighbouring ones; the margin is for rounding
    band = F.when(blocks == 1, -1).otherwise(F.floor(F.log("n") / (math.log(100 / percent) * 1.001 if percent < 100 else 1.0))).cast("int")
    own = members.withColumns({"blocks": blocks, "band": band, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    # in the group of a band, blocks of the next band have the upper numbers
    upto = F.when(F.col("blocks") == 1, 0).otherwise(2 * F.col("blocks") - 1)
    columns = ("tile", "band", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "node", "part", "n", "bits")
    here = own.withColumn("at", F.col("block")).withColumn("other", F.explode(F.sequence(F.lit(0), upto))).select(*columns)
    below = own.filter("blocks > 1").withColumns({"band": F.col("band") - 1, "at": F.col("blocks") + F.col("block")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        node, part, n, block = (table.column(c).to_numpy() for c in ("node", "part", "n", "at"))
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = [], []
        for x in np.flatnonzero(block == i):
            # pairs of one block once, by node; pairs of two blocks from the first
            y = np.flatnonzero((part != part[x]) & (node > node[x] if i == j else block == j))
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
            common = np.minimum((n[y] + n[x] - apart) // 2, np.minimum(n[y], n[x]))
            y = y[100 * common >= percent * (n[y] + n[x] - common)]
            a.append(np.minimum(node[y], node[x]))
            b.append(np.maximum(node[y], node[x]))
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(a), "b": join(b)})

    return here.union(below).groupBy("tile", "band", "i", "j").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, fingerprint (xxhash64 of the text), n_shingles, component_id, row (an id), first (its row is the component's least by doc_id)."""
    p = own_name(docs, "p")
    text_of = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    key = F.unhex(F.md5("text"))
    seen = text_of.withColumn(p, _profile(words, percent)("text")).select("doc_id", F.xxhash64("text").alias("fingerprint"), key.alias("content_key"), F.monotonically_increasing_id().alias("row"), f"{p}.*")
    seen = written(seen)
    filled = seen.filter("set is not null")
    # one node for each distinct set that can have links; its least row stands for it
    nodes = written(filled.filter("size(tiles) > 0").groupBy("set").agg(F.min(F.struct("row", "content_key", "n", "bits", "tiles")).alias("of")).select("set", F.col("of.row").alias("node"), "of.content_key", "of.n", "of.bits", "of.tiles"))
    members = nodes.select("node", F.explode("tiles").alias("tile"))
    tiles = members.groupBy("tile").agg(F.count("*").alias("size")).filter("size > 1")
    shared = checkpoint(members.join(tiles, "tile"))
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("tile").agg(F.max(F.struct("weight", -F.col("node"))).alias("hub")).select("tile", (-F.col("hub")["col2"]).alias("hub"))
    spokes = shared.join(hubs, "tile").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    texts = text_of.filter("text is not null").select(key.alias("content_key"), "text")
    stars = checkpoint(_verified(spokes, nodes, texts, words, percent))
    # what the stars leave apart in a tile
    parts = checkpoint(shared.join(components(stars), "node", "left").select("tile", "node", "size", F.coalesce("component", "node").alias("part")))
    open_tiles = parts.groupBy("tile").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("tile")
    rest = checkpoint(_near_pairs(parts.join(open_tiles, "tile").join(nodes.select("node", "n", "bits"), "node"), percent).distinct())
    found = components(stars.union(_verified(rest, nodes, texts, words, percent)))
    sets = nodes.select("set", "node").join(found, "node").select("set", F.col("component").cast("string").alias("component"))
    # least doc_id of a set, then of a component, each counted before it meets; a set without links is its own component
    least = filled.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint", "row")).alias("least"))
    sets = checkpoint(least.join(sets, "set", "left").select("set", F.coalesce("component", F.hex("set")).alias("component"), "least"))
    first = sets.groupBy("component").agg(F.min("least").alias("first"))
    sets = sets.join(first, "component").select("set", "first")
    out = seen.select("doc_id", "fingerprint", "n", "row", "set").join(sets, "set", "left")
    return out.select("doc_id", "fingerprint", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "row", (F.col("set").isNull() | (F.col("row") == F.col("first.row"))).alias("first"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class: the least doc_id. Where rows repeat whole, one of them stays. Texts without words all stay.

    Only documents that may go, by a bitmap of fixed size, are shuffled to be judged one by one.
    """
    k, asked, stays = own_name(docs, "row_key"), own_name(docs, "asked"), own_name(docs, "stays")
    key = lambda i, f: F.xxhash64(F.coalesce(i, F.lit(0)), i.isNull(), f)
    rows = classes(docs, doc_id, text, words, percent).filter("n_shingles > 0").withColumn(k, key(F.col("doc_id"), F.col("fingerprint")))
    judged = rows.groupBy(k).agg(F.max("first").alias(stays), F.count("*").alias("n"))
    contested = checkpoint(judged.filter(~F.col(stays) | (F.col("n") > 1)).select(k, stays))
    keyed = docs.withColumn(k, key(F.col(f"`{doc_id}`"), F.xxhash64(f"`{text}`")))
    tested = may_be_in(keyed, F.col(k), contested.select(k), asked)
    met = tested.filter(asked).join(contested, k, "left")
    # rows of one key repeat doc_id and text
    parts = (tested.filter(~F.col(asked)), met.filter(F.col(stays).isNull()), met.filter(stays).dropDuplicates([k]))
    return reduce(DataFrame.union, (x.select(*(f"`{c}`" for c in docs.columns)) for x in parts))


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
grams as (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from words)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as i from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by all),
links as (select a, b from common join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * i >= 90 * (s.n + t.n - i)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
from documents d left join sizes s on s.doc_id = d.doc_id join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id
"""
