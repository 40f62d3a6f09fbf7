"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame; run() writes each
to the shared folder as Parquet and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import near_copies, personal_data, piece_codec, templates, toxicity
from scholia.llm._spark import bounded, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learns from all their labels. Rows stay as they are, repeated ones too.

    Null and empty texts are scored as texts without words and stay; labels of unknown or null ids teach nothing; an empty table stays empty.
    """
    bounded(spark)
    labels = table(spark, sf_dir, "labels")
    return toxicity.clean(docs, "text", toxicity.fit(docs, "text", "doc_id", labels, "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Near copies share 0.8 or more of their five-word shingles; every link is verified by the whole sets. All null, empty and blank texts
    are copies of each other, so one of them stays; of repeated rows of the smallest doc_id one stays. An empty table stays empty.
    """
    bounded(spark)
    return near_copies.kept(docs, "text", "doc_id", words=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing; rows without an id stay; repeated rows go or stay together."""
    bounded(spark)
    return templates.clean(docs, "text", "doc_id", table(spark, sf_dir, "benchmark"), "text", "item_id")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. A null text stays null, repeated rows stay, other columns are untouched."""
    masked = personal_data.masked(docs, "text", "doc_id")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text: doc_id, token_ids, n_tokens, exact. Null and empty texts have no ids; each repeated row has its own."""
    bounded(spark)
    # executors that have run the other stages have less memory to spare than those that only encode
    return piece_codec.encode(docs, "text", "doc_id", kept_bytes=24 << 20).withColumnsRenamed({"id": "doc_id", "ids": "token_ids"})


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal-data", mask_personal_data),
    ("sentencepiece", encode),
]

#: Label model, components of near copies and BPE are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each on what the one before has written. Empty documents give an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
