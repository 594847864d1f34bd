"""End-to-end flows as transformations of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.rules import rule_clean
from corvane.functions.structure import drop_headings
from corvane.operators import chunk, dataset, model, requests
from corvane.session import frozen
from corvane.sources import files


def clean_and_chunk(docs: DataFrame, text_col: str = "text", limit: int = chunk.SENTENCE_LIMIT) -> DataFrame:
    """docs without text_col, with chunk_idx, text and n_chars. One stage without a shuffle."""
    cleaned = docs.withColumn(text_col, X.clean_text(F.col(text_col)))
    return chunk.chunk_by_sentences(cleaned, text_col, limit).withColumn("n_chars", F.length("text").cast("long"))


def pending(spark: SparkSession, folder: str, done: DataFrame | None = None) -> DataFrame:
    """(path, length) of the supported files below a folder that are not in done (path)."""
    found = files.listed(spark, folder)
    return found if done is None else dataset.not_done(found, done, "path")


def make_dataset(spark: SparkSession, folder: str, done: DataFrame | None = None, cleaner: str = "none", backend: model.Backend | None = None, limit: int = chunk.SENTENCE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of a folder.

    chunks: path, ext, chunk_idx, text. rejected: path, error, of files that can't be read or have no text.
    cleaner: none, rules (the built-in one) or model (with a backend). Chunks of which nothing is left are dropped.
    """
    todo = frozen(pending(spark, folder, done), "pending-files")
    extracted = frozen(files.extract_pending(spark, todo), "extracted-files")
    cleaned = extracted.filter("error IS NULL").select("path", "ext", "part", X.clean_text(F.col("text")).alias("text"))
    if cleaner == "rules":
        cleaned = cleaned.withColumn("text", drop_headings(F.col("text")))  # section numbers rise through a whole document
    cleaned = cleaned.withColumn("__pieces", F.size(chunk.sentence_pieces(F.col("text"))))
    empty = cleaned.groupBy("path").agg(F.max("__pieces").alias("most")).filter("most = 0").select("path", F.lit("nothing extracted from source").alias("error"))
    rejected = extracted.filter("error IS NOT NULL").select("path", "error").union(empty)
    chunks = chunk.chunk_by_sentences(cleaned.drop("__pieces"), "text", limit)
    # the chunks of a large file's parts are numbered one part after the other
    chunks = chunks.select("path", "ext", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("chunk_idx")).alias("chunk_idx"), "text")
    if cleaner == "rules":
        chunks = chunks.withColumn("text", rule_clean(F.col("text")))
    elif cleaner == "model":
        if backend is None:
            raise ValueError("the model cleaner needs a backend")
        answered = frozen(model.model_clean(chunks, backend), "cleaned-chunks")  # the model runs once
        rejected = rejected.union(answered.filter("error IS NOT NULL").select("path", "error"))
        chunks = answered.filter("error IS NULL").withColumn("text", F.col("value")).drop("value", "error")
    elif cleaner != "none":
        raise ValueError(f"no cleaner {cleaner}")
    return chunks.filter(F.length("text") > 0), rejected


def training_table(chunks: DataFrame, key_col: str, eos: str, test_size: float = 0.1, seed: int = 3407) -> DataFrame:
    """chunks with the end-of-sequence marker and a split."""
    return dataset.with_eos(dataset.train_test_split(chunks, key_col, test_size, seed), eos)


def extract_markdown(pages: DataFrame, backend: model.Backend, limit: int = chunk.OVERLAP_LIMIT, overlap: int = chunk.OVERLAP_WORDS, context: int = 400_000, **more) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of page texts (path, page_no, text): marked, normalised, capped, sent to a model, chunked with overlap."""
    raw = dataset.joined_pages(pages, "path", "page_no").withColumn("text", X.cap(X.normalize_whitespace(F.col("text")), context))
    answered = frozen(model.apply_model(raw, backend, **more), "extracted-markdown")
    stem = X.stem(F.col("path"))
    docs = answered.withColumn("markdown", X.title_header(stem, X.strip(F.col("value")))).withColumn("stem", stem).drop("value")
    chunks = chunk.chunk_with_overlap(docs.filter("error IS NULL").select("path", F.col("markdown").alias("text")), "text", limit, overlap)
    return docs, chunks


def extract_files(pages: DataFrame, files: DataFrame, backend: requests.FileBackend, budget: int = requests.BUDGET, limit: int = chunk.OVERLAP_LIMIT, overlap: int = chunk.OVERLAP_WORDS, **more) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) like extract_markdown(), from page texts (path, page_no, text) and the files themselves (path, content), whatever their size."""
    packed = frozen(requests.packed_requests(pages, files, budget), "file-requests")
    answered = frozen(requests.stitched(requests.extract_with_files(packed, backend, **more)), "extracted-markdown")  # the model runs once
    stem = X.stem(F.col("path"))
    docs = answered.withColumn("markdown", X.title_header(stem, X.strip(F.col("value")))).withColumn("stem", stem).drop("value")
    return docs, chunk.chunk_with_overlap(docs.filter("error IS NULL").select("path", F.col("markdown").alias("text")), "text", limit, overlap)
