"""The subpackage's queries by name: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.store import spread

from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digest(chat.render(chat.events_of(rows.unionByName(extra))))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join_components(spread(table(spark, sf_dir, "documents")), 3, 90, 100).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifier

    documents, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    model = classifier.train(documents, labels.where(~classifier.held_out()))
    out = classifier.scores(documents.select("doc_id", "text"), model)
    return out.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.repeated_passages(spread(table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract_pages(spread(table(spark, sf_dir, "pages")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("score")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    out = pii.anonymise(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), pii.session_key(spark), spans=True)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.to_json("entities").alias("entities"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.apply_rules(spread(table(spark, sf_dir, "documents")))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import prefix_bpe

    return prefix_bpe.round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hard_negatives

    label = F.col("label").cast("long")
    rows = spread(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, rows["vec_id"] % 50 == 0)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    rows = spread(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows))


def queries() -> dict:
    own = (op1_chat_formatting, op2_bpe_encode_decode, op3_ngram_jaccard_join, op4_quality_classifier, op5_substring_dedup, op6_html_extraction, op7_url_filters, op8_benchmark_decontamination, op9_pii_surrogates, op10_quality_rules, op11_prefix_bpe, op12_hard_negatives, op13_embedding_whitening)
    return {f.__name__: f for f in own}
