"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontaminate, fingerprints, near_dedup, packing, page_text, pii, quality, token_counts, token_files, toxicity
from lodestrand.llm.common import documents, labels, place_for


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    """The pre-tokenizer's pattern of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), near_dedup.Params(words=2))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), byte_pattern(), limit=1024)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = documents(spark, sf_dir), quality.fold(F.col("doc_id"), 5)
    model = quality.fit(docs, labels(spark, sf_dir), part != 0)
    scores = quality.quality_scores(docs, model, threshold=0.3)
    return scores.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place_for(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = documents(spark, sf_dir), quality.fold(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels(spark, sf_dir), part != 1)
    scores = toxicity.toxicity_scores(docs, model, threshold=0.7)
    return scores.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_toxic_windows")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_near_dedup, op2_token_counts, op3_quality, op4_pii, op5_fingerprints, op6_decontamination, op7_token_files, op8_packing, op9_toxicity, op10_page_text]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None of the registered queries so far can be told in SQL; they are tested against brute force."""
    return {}
