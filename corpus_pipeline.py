"""From raw documents to token ids in five stages, each written as Parquet and read again.

1. quality classifier: documents that it rejects go
2. SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) the
   smallest doc_id stays
3. benchmark decontamination: documents that hold a benchmark window go
4. PII: personal data and disclosing terms are taken out of the texts
5. SentencePiece: the texts become ids, and ids texts again

Stages 1 to 4 keep the columns of ``documents``. Null texts count as empty; every stage works on all
rows of the one before, and an empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, labelled, near_copies, pii, piece_coder, quality, shared


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = shared.table(spark, sf_dir, "labels").where(labelled.fold("doc_id", 5) != 0)
    return quality.keep_good(docs, labels.select("doc_id", F.col("quality").alias("label")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, shared.table(spark, sf_dir, "benchmark"))


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs, pii.find(docs))
    return clean.select(*(F.coalesce(F.length("text").cast("long"), c).alias(c) if c == "n_chars" else c for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    return piece_coder.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", select_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("pii", take_out_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot train the classifier or replay the merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the result of the last, read from what it wrote."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared.fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
