"""The corpus pipeline: from raw documents to a mixed, tokenised training table.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and calls one operator; its result
is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, langid, minhash, mixing
from corvane.llm.queries import vocabulary
from corvane.llm.shared import scope, stage, table
from corvane.session import ship

#: The least corrected share of known n-grams of a document's language. Text of a learnt language is far above it.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised."""
    ship(spark)
    judged = langid.predict_columns(docs.withColumnsRenamed({"score": "__score", "lang_pred": "__lang_pred"}), langid.fit_documents(docs))
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__score": "score", "__lang_pred": "lang_pred"})


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word shingles and a similarity of 0.8 or more."""
    ship(spark)
    return minhash.drop_near_copies(docs, words=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights, in a global random order."""
    return mixing.poisson_mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, with digests of the ids and of what they decode to."""
    ship(spark)
    return bpe.encode_documents(docs, vocabulary())


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("MinHash near-dedup", near_copies), ("mixing sources", source_mix), ("BPE", tokens)]
#: SQL can express neither the language filter nor MinHash nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written on its way, and the table before it, go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    with scope(spark) as tables:
        for name, function in STAGES:
            own = "pipeline-" + name.replace(" ", "-")
            docs = stage(function(spark, docs, sf_dir), own)
            tables.drop(own)
    return docs
