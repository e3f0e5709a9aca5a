"""From ``documents`` to packed training sequences: rules, classifier, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns the columns of documents; the
last returns the pieces of packed sequences. Quality rules and classifier let rejected documents go, one document of each
group of near copies (five-word shingles, similarity 0.8 or more) stays, and secrets are replaced by a mark.

In all stages null texts are empty, rows without doc_id or with that of another row are rows of their own, repeated rows
are treated alike, further columns pass, and empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import classifier, jaccard, packing, quality, secrets
from tessel.llm._common import scratch
from tessel.llm.queries import table, tokenizer

#: Documents that score less go.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that trees fitted on labelled ones of ``docs`` score LEAST_SCORE or more; all of them without labels."""
    return classifier.keep_good(docs, classifier.train_on(docs, table(spark, sf_dir, "labels")), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, and one of equal rows."""
    return jaccard.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; null texts stay null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences; an empty text is a piece of its end token."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: SQL has no estimates, trees or packing: tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
