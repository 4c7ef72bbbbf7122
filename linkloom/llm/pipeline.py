"""Stages of a training-data pipeline: each takes documents and returns what it keeps, with the same columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, language, packing, rules, secrets
from .queries import BYTE_BPE

#: A text without a language, or in which none reaches this share, is rejected.
LEAST_SHARE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Depleted documents and those that fail a rule go, null and empty texts among them; from the others, lines above
    the limit are taken out, and their lengths are set anew. Both by the frequencies of lines in all documents of the
    stage. Each row has its own verdict: null and repeated ids, repeated rows and further columns change nothing."""
    return rules.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or in which none reaches LEAST_SHARE, go, null and empty texts among them. The
    model learns from the stage's own documents with a language; without any, all go. Each row has its own verdict:
    null and repeated ids, repeated rows and further columns change nothing."""
    return language.keep_known(docs, language.train(docs), LEAST_SHARE).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest id stays (nulls last), of rows that agree in id
    and text one. Rows without words stay; so do rows of other components that share an id with one that goes."""
    return jaccard.keep_one(docs).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts, and their lengths are set anew (null for a null text). All rows stay, with
    their ids, repeats and further columns."""
    return secrets.redact_column(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document's ids; a null or empty text has one id. Repeated rows are documents of their
    own, ids may be null, and further columns are ignored."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan), ("harmonic_packing", harmonic_packing)]
