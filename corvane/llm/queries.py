"""The queries op1 to op13, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import exact_dedup

    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import bpe

    return bpe.bpe_columns(table(spark, sf_dir, "documents"), vocabulary())


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import warc

    made = warc.derive_records(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "content_type", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import lm_scoring

    docs = table(spark, sf_dir, "documents")
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    models = lm_scoring.fit(lm_scoring.mark_targets(docs, wanted), bits=lm_scoring.key_bits(docs))
    return lm_scoring.score(docs, models)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import media

    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import token_output

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")  # as it is stored, for the order follows its files
    return token_output.token_output(docs, token_output.byte_bpe(vocabulary()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit_documents(docs)
    rows = docs.select("doc_id", "text", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"))
    return langid.predict_columns(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import mixing

    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)  # of the text as it arrives
    return mixed.select("doc_id", "source", digest.alias("text_sha256"), "n_copies", "copy_no", "order_key")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import html_extract

    return html_extract.extract_columns(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import divergence

    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import importance

    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"))
    return toxicity.score_columns(rows, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_warc_derivatives, op4_lm_scoring, op5_media_columns, op6_token_output, op7_language_id, op8_poisson_mixing, op9_html_extraction, op10_minhash_near_dedup, op11_source_divergence, op12_importance_resampling, op13_toxicity)}


def oracles() -> dict[str, str]:
    from corvane.llm import divergence, exact_dedup, importance, mixing

    return {"op1_exact_dedup": exact_dedup.ORACLE, "op8_poisson_mixing": mixing.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_importance_resampling": importance.ORACLE}
