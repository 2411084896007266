"""The numbered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import os

from . import op1_decontaminate, op2_quality_classifier, op3_bpe, op4_pii, op5_secrets, op6_quality_rules, op7_line_dedup, op8_ngram_jaccard, op9_url_filters, op10_html_extraction
from .common import read


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary: BPE_VOCABULARY, or else the installed public file."""
    if path := os.environ.get("BPE_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict:
    docs = lambda s, d: read(s, d, "documents")
    return {
        "op1_decontaminate": lambda s, d: op1_decontaminate.leaked_pairs(docs(s, d), read(s, d, "benchmark")),
        "op2_quality_classifier": lambda s, d: op2_quality_classifier.score(docs(s, d), read(s, d, "labels")),
        "op3_bpe": lambda s, d: op3_bpe.digest(docs(s, d), vocabulary()),
        "op4_pii": lambda s, d: op4_pii.digest(docs(s, d)),
        "op5_secrets": lambda s, d: op5_secrets.digest(docs(s, d)),
        "op6_quality_rules": lambda s, d: op6_quality_rules.digest(docs(s, d)),
        "op7_line_dedup": lambda s, d: op7_line_dedup.digest(docs(s, d)),
        "op8_ngram_jaccard": lambda s, d: op8_ngram_jaccard.digest(docs(s, d)),
        "op9_url_filters": lambda s, d: op9_url_filters.verdicts(read(s, d, "pages")),
        "op10_html_extraction": lambda s, d: op10_html_extraction.extract(read(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": op6_quality_rules.SQL, "op7_line_dedup": op7_line_dedup.SQL, "op8_ngram_jaccard": op8_ngram_jaccard.SQL, "op9_url_filters": op9_url_filters.SQL}
