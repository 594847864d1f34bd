"""Extraction of whole documents by a model that takes the file itself: pages and file bytes packed into requests under a byte budget, answers stitched."""

from __future__ import annotations

import json
import time
import urllib.request
from base64 import b64encode
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.model import EXTRACTION_PROMPT, with_retries

#: Bytes of a file's slice and of texts that a request carries at most, together.
BUDGET = 4 << 20
#: A file backend is a picklable factory: called once a task, it gives a function from (slice of the file or None, text, instruction) to an answer.
FileBackend = Callable[[], Callable[[bytes | None, str, str], str]]


def greedy(sizes: list[int], budget: int) -> list[int]:
    """The request of each piece in order: a new one begins where the next piece doesn't fit."""
    out, request, n = [], -1, budget + 1
    for size in sizes:
        if n + size > budget:
            request, n = request + 1, 0
        n += size
        out.append(request)
    return out


def packed_requests(pages: DataFrame, files: DataFrame, budget: int = BUDGET, path_col: str = "path", page_col: str = "page_no", text_col: str = "text", content_col: str = "content") -> DataFrame:
    """(path, request, requests, content, text): the requests of each document from 0 on, in which every byte of its file and of its page texts is once, in order.

    A file is cut into slices of budget bytes, which come first, and pages with their markers follow; a page that is larger than a request goes on in the next. Requests are
    filled greedily. Documents that have pages or a file alone are taken, too; empty files and null texts add nothing, and a document with neither has no request. Only sizes
    meet in one place for a document (a number for each piece); contents are sent once, to their request.
    """
    if budget < 8:
        raise ValueError("budget must be at least 8 bytes")
    chars = budget // 4  # no character has more bytes
    marked = X.page_marked(F.col(page_col), F.col(text_col))
    texts = pages.filter(F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.lit(1).alias("kind"), F.col(page_col).cast("long").alias("no"), marked.alias("t"))
    texts = texts.select("path", "kind", "no", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chars)), lambda k: F.substring(F.col("t"), k.cast("int") * chars + 1, F.lit(chars)))).alias("part", "text"))
    texts = texts.select("path", "kind", "no", "part", F.lit(None).cast("binary").alias("content"), "text", F.octet_length("text").cast("long").alias("size"))
    own = files.filter(F.octet_length(F.col(content_col)) > 0).select(F.col(path_col).alias("path"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("no"), F.col(content_col).alias("c"))
    slices = own.select("path", "kind", "no", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("c") - 1) / budget)), lambda k: F.substring(F.col("c"), k.cast("int") * budget + 1, F.lit(budget)))).alias("part", "content"))
    pieces = slices.select("path", "kind", "no", "part", "content", F.lit("").alias("text"), F.octet_length("content").cast("long").alias("size")).unionByName(texts)

    @F.arrow_udf("array<int>")
    def placed(sizes: pa.Array) -> pa.Array:
        return pa.array([greedy(x, budget) for x in sizes.to_pylist()], pa.list_(pa.int32()))

    order = pieces.select("path", "kind", "no", "part", "size").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("kind", "no", "part", "size"))).alias("ps"))
    order = order.withColumn("places", placed(F.transform("ps", lambda p: p["size"])))
    order = order.select("path", (F.array_max("places") + 1).alias("requests"), F.explode(F.arrays_zip("ps", "places")).alias("z")).select("path", "requests", "z.ps.kind", "z.ps.no", "z.ps.part", F.col("z.places").alias("request"))
    joined = pieces.join(order, ["path", "kind", "no", "part"])
    # a request holds one slice at most, as all but a file's last one fill theirs
    grouped = joined.groupBy("path", "request").agg(F.first("requests").alias("requests"), F.first("content", ignorenulls=True).alias("content"), F.array_sort(F.collect_list(F.struct("kind", "no", "part", "text"))).alias("ts"))
    return grouped.select("path", "request", "requests", "content", F.array_join(F.transform("ts", lambda t: t["text"]), "").alias("text"))


def instruction(request: int, requests: int, prompt: str = EXTRACTION_PROMPT) -> str:
    """The prompt, and where a request stands in its document."""
    return prompt if requests == 1 else f"{prompt}\nThis is part {request + 1} of {requests} of the document; answer for this part alone, going on where the last part ended."


def extract_with_files(requests: DataFrame, backend: FileBackend, prompt: str = EXTRACTION_PROMPT, attempts: int = 3, pause: tuple[float, float, float] = (1.0, 2.0, 10.0)) -> DataFrame:
    """requests with value and error instead of what was sent. A request that fails after all attempts is a row with its error."""
    kind = requests.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = backend()
        call = with_retries(lambda r: send(*r), attempts, *pause, sleep=time.sleep)
        for batch in batches:
            for r in batch.itertuples(index=False):
                value = error = None
                try:
                    value = call((None if r.content is None else bytes(r.content), r.text, instruction(r.request, r.requests, prompt)))
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [r.path], "request": [r.request], "requests": [r.requests], "value": pd.Series([value], dtype=object), "error": pd.Series([error], dtype=object)})

    return requests.select("path", "request", "requests", "content", "text").mapInPandas(run, f"path {kind}, request int, requests int, value string, error string")


def stitched(answers: DataFrame) -> DataFrame:
    """(path, value, error): the answers of each document in order, a blank line between them; null, and the first error, if any request failed."""
    found = answers.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("request", F.trim("value").alias("value")))).alias("vs"), F.min_by(F.concat(F.lit("part "), (F.col("request") + 1).cast("string"), F.lit(": "), F.col("error")), F.when(F.col("error").isNotNull(), F.col("request"))).alias("error"))
    whole = F.array_join(F.filter(F.transform("vs", lambda v: v["value"]), lambda v: v != ""), "\n\n")
    return found.select("path", F.when(F.col("error").isNull(), whole).alias("value"), "error")


class HttpFileBackend:
    """A generation server that takes files: POST {model, contents: [{file, mime}, {text}...], generation} and read "response"."""

    def __init__(self, url: str, model: str, mime: str = "application/pdf", most_tokens: int = 8192, temperature: float = 0.1, timeout: float = 600.0) -> None:
        self.url, self.model, self.mime, self.timeout = url, model, mime, timeout
        self.generation = {"max_output_tokens": most_tokens, "temperature": temperature}

    def __call__(self) -> Callable[[bytes | None, str, str], str]:
        def generate(content: bytes | None, text: str, prompt: str) -> str:
            parts = ([] if content is None else [{"file": b64encode(content).decode(), "mime": self.mime}]) + [{"text": text}, {"text": prompt}]
            body = json.dumps({"model": self.model, "contents": parts, "generation": self.generation}).encode()
            with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as response:  # noqa: S310
                return json.load(response)["response"]

        return generate


class EchoFileBackend:
    """A deterministic stand-in: answers with the sizes and the text of what it got; fails on a marker."""

    def __init__(self, fail_on: str | None = None) -> None:
        self.fail_on = fail_on

    def __call__(self) -> Callable[[bytes | None, str, str], str]:
        def generate(content: bytes | None, text: str, prompt: str) -> str:
            if self.fail_on and self.fail_on in text:
                raise RuntimeError("the model failed")
            return f"[{len(content or b'')}]{' '.join(text.split())}"

        return generate
