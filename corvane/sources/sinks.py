"""Writers: tables first, and an export of one file per source where that is asked for."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import stem


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json", partition_by: tuple[str, ...] = ()) -> None:
    """Non-empty chunks as a table (JSON lines or Parquet)."""
    chunks.filter(F.length("text") > 0).write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def export_json(chunks: DataFrame, path_col: str = "out_path", order_col: str = "chunk_idx", keep_empty_files: bool = True) -> DataFrame:
    """Writes one JSON array of {"text"} per out_path (UTF-8, indent 2) into a shared file system; returns (path, n).

    Rows of a file come together and in order by one shuffle on the path. Empty texts are dropped; a file
    without others holds [].
    """
    own = chunks.select(F.col(path_col).alias("path"), F.col(order_col).alias("idx"), "text").repartition("path").sortWithinPartitions("path", "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, texts = None, []

        def done() -> pd.DataFrame | None:
            if now is None or not texts and not keep_empty_files:
                return None
            os.makedirs(os.path.dirname(now) or ".", exist_ok=True)
            part = f"{now}.part{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                json.dump([{"text": t} for t in texts], f, ensure_ascii=False, indent=2)
            os.replace(part, now)  # a task that runs twice leaves one whole file
            return pd.DataFrame({"path": [now], "n": [len(texts)]})

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                if path != now:
                    if (row := done()) is not None:
                        yield row
                    now, texts = path, []
                if text:
                    texts.append(text)
        if (row := done()) is not None:
            yield row

    return own.mapInPandas(run, "path string, n long")


def write_chunks_json(chunks: DataFrame, folder: str, source_col: str = "source", order_col: str = "chunk_idx") -> DataFrame:
    """<stem>__chunks.json with an array of {"text"} for each source, in a shared folder; returns (path, n)."""
    name = F.concat(F.lit(folder.rstrip("/") + "/"), stem(F.col(source_col)), F.lit("__chunks.json"))
    return export_json(chunks.withColumn("out_path", name), "out_path", order_col)


def write_chunks_jsonl(chunks: DataFrame, path: str, source_col: str = "source") -> None:
    """{"id", "text", "meta": {"source", "start", "end"}} per line; needs start and end (with_offsets())."""
    meta = F.struct(F.col(source_col).alias("source"), "start", "end")
    chunks.select("id", "text", meta.alias("meta")).write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, folder: str, stem_col: str = "stem", text_col: str = "markdown") -> DataFrame:
    """<stem>__extracted.md per row in a shared folder; returns (path, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stem, text in zip(batch["stem"], batch["text"], strict=True):
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, f"{stem}__extracted.md")
                part = f"{path}.part{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text or "")
                os.replace(part, path)
                rows.append((path, len(text or "")))
            yield pd.DataFrame(rows, columns=["path", "n"])

    return df.select(F.col(stem_col).alias("stem"), F.col(text_col).alias("text")).mapInPandas(run, "path string, n long")


def write_catalogue(books: DataFrame, path: str, indent: int | None = 4, ascii_only: bool = False) -> str:
    """A catalogue as one JSON array, row by row through the driver; .json is added where it is missing."""
    path = path if path.endswith(".json") else path + ".json"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(books.toLocalIterator(prefetchPartitions=True)):
            item = json.dumps(row.asDict(recursive=True), ensure_ascii=ascii_only, indent=indent)
            pad = "\n" + " " * (indent or 0)
            f.write(("," if k else "") + pad + item.replace("\n", pad))
        f.write("\n]\n")
    return path


def save_json(data: object, name: str, folder: str = "results", indent: int | None = 4, ascii_only: bool = False) -> str:
    """A plain object as <folder>/<name>.json (.json is added where it is missing), whole or not at all; returns the path. What JSON has no form for is written as its text."""
    path = os.path.join(folder, name if name.endswith(".json") else name + ".json")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=ascii_only, indent=indent, default=str)
    os.replace(part, path)
    return path
