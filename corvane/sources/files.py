"""Folders of documents and JSON files as tables."""

from __future__ import annotations

import codecs
import io
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.html import TextParser, parsed_text
from corvane.functions.text import extension

SUPPORTED = (".pdf", ".djvu", ".html", ".htm", ".txt")
#: File names of the supported kinds, in upper or lower case; the source lists no others.
SUPPORTED_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in ext[1:]) for ext in SUPPORTED) + "}"
#: Larger files don't fit a value of Spark's binary type.
MOST_BYTES = (1 << 31) - 1
#: Text and HTML files beyond so many bytes are read in pieces of about PIECE characters; bytes of files that a task reads, about.
WHOLE, PIECE, TASK_BYTES = 1 << 28, 1 << 24, 1 << 27
#: Schemes of stores that tasks open themselves (by pyarrow); files of others are read by Spark.
DIRECT = ("file", "hdfs", "s3", "s3a", "gs", "abfss")


def scan_folder(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file below a folder. Selecting path or length alone doesn't read contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the supported files below a folder; no contents are read."""
    return scan_folder(spark, folder, SUPPORTED_GLOB).select("path", "length")


def opened(spark: SparkSession, pending: DataFrame) -> DataFrame:
    """The files of pending (path, length) with their contents, but for those that are too large for a value.

    Only these files are read, and their contents aren't moved between tasks. Their paths pass the driver, which holds the listing of
    any file source; extract_pending() does without that.
    """
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in pending.filter(F.col("length") < MOST_BYTES).select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], schemas.SOURCE_FILE)
    return spark.read.format("binaryFile").load(paths)


def handler(ext: Column) -> Column:
    """The extractor of a suffix; null for one that isn't supported."""
    return F.when(ext.isin(".html", ".htm"), F.lit("html")).when(ext.isin(*SUPPORTED), F.substring(ext, 2, 10))


def supported(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files with ext and handler, others left out. It precedes reading contents."""
    return files.withColumn("ext", extension(F.col(path_col))).withColumn("handler", handler(F.col("ext"))).filter(F.col("handler").isNotNull())


def _pdf_pages(content: bytes | BinaryIO) -> list[str]:
    from PyPDF2 import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(content) if isinstance(content, bytes) else content).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  a page that can't be read is empty
            pages.append("")
    return pages


def _pdf(content: bytes | BinaryIO) -> str:
    return " ".join("".join(p + "\n" for p in _pdf_pages(content) if p).split())


def _djvu(content: bytes | BinaryIO) -> str:
    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, "in.djvu"), os.path.join(folder, "out.txt")
        with open(source, "wb") as f:
            shutil.copyfileobj(io.BytesIO(content) if isinstance(content, bytes) else content, f, 1 << 20)
        subprocess.run(["djvutxt", source, target], check=True, capture_output=True)  # noqa: S603, S607
        with open(target, encoding="utf-8") as f:
            return " ".join(f.read().split())


def _html(content: bytes) -> str:
    return parsed_text(content.decode("utf-8"))


def _txt(content: bytes) -> str:
    return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


EXTRACTORS = {".pdf": _pdf, ".djvu": _djvu, ".html": _html, ".htm": _html, ".txt": _txt}


def extract(files: DataFrame) -> DataFrame:
    """(path, ext, text, error) of supported files: text, or null and the error of that file alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                try:
                    rows.append((path, ext, EXTRACTORS[ext](content), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, ext, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ext", "text", "error"]).astype(object)

    return supported(files).select("path", "ext", "content").mapInPandas(run, schemas.EXTRACTED)


def open_path(path: str) -> pa.NativeFile:
    """The file of a path as Spark writes it (not percent-encoded)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    filesystem, place = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))
    return filesystem.open_input_file(unquote(place))


def _decoded(file: pa.NativeFile) -> Iterator[str]:
    """The text of a UTF-8 file in pieces, line ends as \\n."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")(), translate=True)
    while raw := file.read(1 << 20):
        yield decoder.decode(raw)
    yield decoder.decode(b"", final=True)


def _parsed(file: pa.NativeFile) -> Iterator[str]:
    """The text of an HTML file in pieces, with a space after each of the parser's."""
    parser = TextParser()
    for piece in _decoded(file):
        parser.feed(piece)
        if parser.parts:
            yield " ".join(" ".join(parser.parts).split()) + " "
            parser.parts.clear()
    parser.close()
    yield " ".join(" ".join(parser.parts).split())


def pieces_of(texts: Iterator[str], size: int = PIECE) -> Iterator[str]:
    """A text in pieces of about size characters that end after a dot, or else after white space."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            whole = "".join(held)
            cut = max(whole.rfind("."), 0) + 1
            if cut == 1:
                cut = max(whole.rfind(" "), whole.rfind("\n")) + 1
            if cut:
                yield whole[:cut]
                held, n = [whole[cut:]], len(whole) - cut
    yield "".join(held)


def extract_path(path: str, ext: str, length: int, whole: int = WHOLE, piece: int = PIECE) -> Iterator[tuple[int, str]]:
    """(part, text) of a file: one part, but for text and HTML files beyond whole bytes."""
    if ext in (".txt", ".html", ".htm") and length > whole:
        read = _decoded if ext == ".txt" else _parsed
        with open_path(path) as f:  # a file that can't be read is an error before it gives a part
            for _ in _decoded(f):
                pass
        with open_path(path) as f:
            yield from enumerate(pieces_of(read(f), piece))
        return
    with open_path(path) as f:
        yield 0, EXTRACTORS[ext](f if ext in (".pdf", ".djvu") else f.read())


def extract_pending(spark: SparkSession, pending: DataFrame, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """(path, ext, part, text, error) of the supported files of pending (path, length): each task opens its paths, of which the driver sees none.

    A file gives one row (part 0) with its text, or with null and its error, whatever it is that can't be opened or read; a text or HTML file beyond ``whole`` bytes gives as many as it needs, cut
    after sentences. Files of stores that tasks can't open (DIRECT) are read by Spark, those of 2 GB and more with an error. Tasks get some TASK_BYTES each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ext, length in zip(batch["path"], batch["ext"], batch["length"], strict=True):
                try:
                    for part, text in extract_path(path, ext, length, whole, piece):
                        yield pd.DataFrame({"path": [path], "ext": [ext], "part": [part], "text": [text], "error": [None]}).astype({"error": object})
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"path": [path], "ext": [ext], "part": [0], "text": [None], "error": [f"{type(e).__name__}: {e}"]}).astype({"text": object})

    scheme = F.regexp_extract("path", "^([a-z][a-z0-9+.-]*):", 1)
    own = supported(pending).select("path", "ext", "length")
    direct = scheme.isin("", *DIRECT)
    size = own.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    read = own.filter(direct).repartition(tasks).mapInPandas(run, "path string, ext string, part int, text string, error string")
    others = own.filter(~direct)
    if others.isEmpty():
        return read
    large = others.filter(F.col("length") >= MOST_BYTES).select("path", "ext", F.lit(0).alias("part"), F.lit(None).cast("string").alias("text"), F.lit("the file is too large").alias("error"))
    return read.unionByName(extract(opened(spark, others)).withColumn("part", F.lit(0))).unionByName(large)


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, text) of PDF files, pages from 1; an unreadable file has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = _pdf_pages(content)
                except Exception:  # noqa: BLE001, S112
                    continue
                yield pd.DataFrame({"path": path, "page_no": range(1, len(pages) + 1), "text": pages})

    return files.select("path", "content").mapInPandas(run, schemas.PAGE_TEXT)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text, path): whole text files in UTF-8."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def read_json_dataset(spark: SparkSession, path: str) -> DataFrame:
    """text of all objects of all *.json below a folder; FileNotFoundError if there are no such files."""
    if spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path").isEmpty():
        raise FileNotFoundError(f"no JSON files in {path}")
    return spark.read.schema(schemas.CHUNK_JSON).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOGUE).option("multiLine", True).json(path)
