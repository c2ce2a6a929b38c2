"""The corpus pipeline: documents through five stages, each of which reads what the one before it has written.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents. Empty tables pass through; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, classifier, decontaminate, ngram_join, pii
from factloom.llm.common import discard, table, written

#: Least score of a document that stays.
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows that are not held out, up to its documented bound of
    each class. Null and empty texts are scored like any other; without enough labels of both classes all documents stay."""
    labels = table(spark, sf_dir, "labels")
    return classifier.accepted(docs, classifier.train(docs, labels.where(~classifier.held_out())), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group that five-word shingles link at a similarity of 0.8 or more. Texts without words
    and rows without a doc_id all stay; rows that repeat a doc_id stay or go together."""
    return ngram_join.one_of_each(docs, 5, 80, 100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts stay; an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced under the session's key; n_chars follows the text. Null and empty texts stay."""
    return pii.anonymise(docs, pii.session_key(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): each text encoded, and decoded from its ids. Null texts have no tokens and the empty text."""
    import public_tokenizers

    return bpe.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("PII", personal_data), ("BPE encoding and decoding", tokens)]

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; each is written to the shared folder and read again, and deleted when the next is written,
    so that no text stays there that the PII stage hasn't seen."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(before)
    return docs
