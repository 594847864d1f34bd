"""Explicit schemas of every table that the engine reads or writes."""

from pyspark.sql import types as T

SOURCE_FILE = T.StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")
DOCUMENT = T.StructType().add("path", "string").add("ext", "string").add("text", "string")
CHUNK_JSON = T.StructType().add("text", "string")
CHUNK = T.StructType().add("id", "string").add("text", "string")
CHUNK_META = T.StructType([*CHUNK.fields]).add("meta", T.StructType().add("source", "string").add("start", "long").add("end", "long"))
PAGE_TEXT = T.StructType().add("path", "string").add("page_no", "integer").add("text", "string")
CATALOGUE = T.StructType().add("title", "string").add("year", "integer").add("author", "string").add("url", "string").add("abstract", "string")
CONVERSATION = T.StructType().add("conversations", T.ArrayType(T.StructType().add("role", "string").add("content", "string")))
TRAINING_EXAMPLE = T.StructType().add("text", "string").add("split", "string")
PROFILE = T.StructType().add("name", "string").add("section", "string").add("key", "string").add("value", "string")
MODEL = T.StructType().add("alias", "string").add("checkpoint", "string")
RUN_REPORT = T.StructType().add("train_runtime_min", "double").add("peak_reserved_memory", "double").add("peak_reserver_memory_training", "double")
RUN_PARAMETER = T.StructType().add("experiment", "string").add("run", "string").add("key", "string").add("value", "string").add("ts", "timestamp")
EXTRACTED = T.StructType().add("path", "string").add("ext", "string").add("text", "string").add("error", "string")
CONVERTED = T.StructType().add("path", "string").add("value", "string").add("error", "string")
DOWNLOAD = T.StructType().add("url", "string").add("path", "string").add("status", "string").add("bytes", "long")
EOS_DEFAULT = "</s>"
