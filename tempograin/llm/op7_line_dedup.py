"""Removal of lines that many documents share, with DataFrame functions only.

A line's key is the line without white space at its ends, A-Z in lower case. Keys are exploded as hashes, each hash's
distinct documents are counted, and lines whose key is in MIN_DOCS documents or more go from every document. Only
hashes and positions are shuffled for that; each text moves once, to meet the positions that it loses. Keys in more than one
document of HOT_SHARE are broadcast instead of shuffled: there are at most HOT_SHARE times the mean number of lines of a document.

Null or empty text: one empty line. Blank lines have no key and always stay. A document is a doc_id; rows without one
count as one document together. Repeated rows are all returned. Extra columns stay as they are. Keys are compared by
two 64-bit hashes, texts of one doc_id by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bind, checkpoint, lower_ascii, own_name

MIN_DOCS = 10
#: A key is hot if one document of so many has it.
HOT_SHARE = 1_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """For each line two hashes of its key; null for a blank line."""
    # lower() touches only A-Z where all characters are ASCII, and is much faster than translate()
    low = bind(F.coalesce(text, F.lit("")), lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(lower_ascii(t)))
    hashes = lambda key: F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))
    return F.transform(F.transform(F.split(low, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES))), hashes)


def shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """id, fingerprint, dropped: the positions that each text loses; texts that lose none aren't there."""
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("fingerprint"), line_keys(F.col(f"`{text}`")).alias("keys"))
    once = base.select("id", F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null")
    # null ids count as one more document, which count_distinct leaves out
    common = once.groupBy("key").agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n")).filter(F.col("n") >= min_docs)
    common = checkpoint(common)
    hot = common.filter(F.col("n") * HOT_SHARE > docs.count()).select("key", F.lit(True).alias("hot"))
    at = base.select("id", "fingerprint", F.posexplode("keys").alias("at", "key")).filter("key is not null").join(F.broadcast(hot), "key", "left")
    # positions of hot keys are decided; they go along under keys of their own
    spread = at.withColumn("key", F.when(F.col("hot"), F.struct(F.col("fingerprint").alias("a"), F.col("at").cast("long").alias("b"))).otherwise(F.col("key")))
    met = spread.join(common.select("key", F.lit(True).alias("shared")), "key", "left").filter("hot or shared")
    return met.groupBy("id", "fingerprint").agg(F.collect_set("at").alias("dropped"))


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: struct of n_lines, n_dropped and the text that stays."""
    out = own_name(docs, "kept_lines")
    lost = shared_lines(docs, doc_id, text, min_docs).select(F.col("id").alias(f"{out}_id"), F.col("fingerprint").alias(f"{out}_f"), F.col("dropped").alias(f"{out}_d"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{out}_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col(f"{out}_f"))
    joined = docs.join(lost, same, "left")
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{out}_d")), lambda i: F.get(lines, i))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = F.struct(
        F.size(lines_of(whole)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col(f"{out}_d")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(f"{out}_d").isNull(), whole).otherwise(F.concat_ws("\n", bind(lines_of(whole), stay))).alias("text"),
    )
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns), kept.alias(out)), out


def digest(docs: DataFrame) -> DataFrame:
    kept, out = drop_shared_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", f"{out}.n_lines", f"{out}.n_dropped", F.sha2(F.col(f"{out}.text"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, i, line, translate(regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
common as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(*) filter (key in (from common))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (key not in (from common)), '')) as kept_sha256
from lines group by doc_id
"""
