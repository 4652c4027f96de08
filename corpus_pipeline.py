"""The corpus pipeline: documents through quality, near copies, decontamination, personal data and packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and gives a DataFrame. All but
the last give the columns of ``documents``: doc_id, text, lang, source, n_chars; further columns of ``docs``, whatever their
names, are dropped. Nulls in any column, repeated rows and empty tables pass through every stage: a null or empty text
gets a quality score like any other, has no near copies, benchmark passages or personal data, and is packed as the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontaminate, near_dedup, packing, pii, quality
from lodestrand.llm.common import documents, labels, materialize, release, scratch
from lodestrand.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled ones among ``docs``, ids with a null
    or two different labels left out. Without labels every score is the same, 0.5, and all documents stay. Copies of a row go or stay together."""
    model = quality.fit(docs, labels(spark, sf_dir), F.lit(True))
    scores = quality.quality_scores(docs, model, threshold=0.3, carry=tuple(COLUMNS[1:]))
    return scores.filter("predicted = 1").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five words to a
    shingle, similarity 0.8. All rows with a kept id stay, and rows with a null id, as each of them is a group of its own."""
    found = near_dedup.near_duplicates(docs, near_dedup.Params(words=5))
    drop = found.filter("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty passages, or none at all, hold nothing back."""
    return decontaminate.clean_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind and n_chars counted anew; every row stays, a null text as it is."""
    return pii.masked_documents(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null or empty text is one piece, the end id."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't tell a fitted classifier, an edit distance or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage gives is written to the shared folder and read again;
    then what it and the stage before wrote there is deleted. The last stage has its own table when it returns."""
    docs, at = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs, new = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.add(new)
        if at:
            release(spark, at)
        at = new
    packed = STAGES[-1][1](spark, docs, sf_dir)
    release(spark, at)
    return packed
