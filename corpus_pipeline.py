"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Its result is written as Parquet and reread as the next one's docs; all but the last have the
columns of documents.

In every stage a null text counts as empty, rows may repeat, and an empty table gives an empty one. A row without a
doc_id is a document of its own text. Columns beside doc_id and text are carried along, n_chars is kept right."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, decontamination, quality, secrets, simhash
from quadrille.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: each row by the score of its own text, so repeated rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id; of rows that are alike in all one. Texts without
    words are one group."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, all rows of their doc_id with them; a text without words has no passage."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every row stays, and a null text stays null."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each row; an empty text has no tokens."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", good), ("SimHash near-dedup", single), ("benchmark decontamination", clean), ("secret scans", masked), ("byte-level BPE", tokens)]

#: SQL can't express the classifier, the components and the encoding; a test holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
