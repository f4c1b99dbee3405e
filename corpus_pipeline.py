"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm import decontaminate, langid, minhash, packing, secrets
from voluma.llm.queries import _byte_bpe
from voluma.llm.shared import stored

#: The language model has no SQL form.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the filters, trained on all labelled documents of the stage's input, can tell.

    Null, empty and letterless texts go; repeated rows and ties stay or go together; an empty table gives none, and so does one
    without labels; other columns pass unchanged.
    """
    return langid.known_language(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Null and wordless texts are no copies and stay, once for each id and text; repeated rows leave one; rows without an id keep
    one of each group; an empty table gives none; other columns pass unchanged.
    """
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark.

    Null and wordless texts stay; repeated rows stay or go together; an empty table gives none, an empty benchmark drops none;
    other columns pass unchanged.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars as it is then.

    Null texts stay null, with a null n_chars; repeated rows give repeated results; an empty table gives none.
    """
    return secrets.redact_secrets(docs, _byte_bpe()).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    A null or empty text is one piece of the end token; repeated rows are packed as often as they stand; an empty table gives no
    piece; of the columns only doc_id and text are read.
    """
    return packing.pack(docs, _byte_bpe(), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
