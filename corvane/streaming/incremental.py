"""Incremental conversion: new files of a folder, each converted once (the file source's log is the memory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane import schemas
from corvane.functions import text as X
from corvane.operators import chunk
from corvane.sources import files


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(schemas.SOURCE_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)


def convert_stream(found: DataFrame, limit: int = chunk.SENTENCE_LIMIT) -> DataFrame:
    """(path, ext, error, chunk_idx, text): chunks of new files; a file that fails is a row with its error."""
    extracted = files.extract(found).withColumn("text", X.clean_text(F.col("text")))
    pieces = chunk.sentence_pieces(F.coalesce("text", F.lit("")))
    chunks = F.filter(chunk._joined(pieces, chunk.sentence_bounds(pieces, limit)), lambda c: c != "")
    rows = extracted.select("path", "ext", "error", F.posexplode_outer(chunks).alias("chunk_idx", "text"))
    return rows.select("path", "ext", F.when(F.col("text").isNull() & F.col("error").isNull(), F.lit("nothing extracted from source")).otherwise(F.col("error")).alias("error"), F.col("chunk_idx").cast("long").alias("chunk_idx"), "text")


def run_incremental(spark: SparkSession, folder: str, out: str, checkpoint: str, limit: int = chunk.SENTENCE_LIMIT) -> StreamingQuery:
    """Converts all files that are new since the last call into Parquet at out, then stops."""
    writer = convert_stream(stream_files(spark, folder), limit).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start(out)
    query.awaitTermination()
    return query
