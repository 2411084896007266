"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.

In every stage: an empty table gives an empty result; a null doc_id is a value like any other; extra columns stay as they are,
whatever their names, up to encode, which returns its own columns only. A null or wordless text goes in the quality stage, as
do very short and very repetitive ones; texts may be of any length. Of repeated rows, and of near copies, the first one by doc_id stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.llm import op1_decontaminate, op3_bpe, op6_quality_rules, op7_line_dedup, op8_ngram_jaccard
from tempograin.llm.common import read, remove, shared_folder
from tempograin.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without shared lines, and their new length."""
    kept, out = op7_line_dedup.drop_shared_lines(docs)
    text = F.col(f"{out}.text")
    return kept.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: 80 % of their five-word shingles in common."""
    return op8_ngram_jaccard.keep_first(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and the digests of each document."""
    coded = op3_bpe.encode_documents(docs, vocabulary(), out="bpe", decoded=False)
    return coded.select("doc_id", "lang", "source", "bpe.n_tokens", "bpe.ids", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet; only the last one's files stay."""
    docs, folder, before = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
