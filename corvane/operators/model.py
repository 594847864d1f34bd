"""Batch inference on a column with a pluggable backend, retries and error columns.

A backend is a picklable factory: called once per task it returns a function from text to text, so a
session or model is opened once for each task. Errors of a row become its error column.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import blank_sentinel, strip_backticks

Backend = Callable[[], Callable[[str], str]]

CLEANING_PROMPT = (
    "You clean text that was extracted from scanned documents. Repair the form only and never the content: rejoin broken words and lines, drop page numbers, running heads, "
    "footnote marks, figure captions, references and headings, keep formulas and the language. Answer with the cleaned text alone, or with NOTHING if nothing is left."
)
EXTRACTION_PROMPT = (
    "Extract everything that the document says as structured Markdown, and answer with the extract alone.\n"
    "1) Leave nothing out: names, states, licences, codes, places, units, ranges, formulas, parameters, shares, dates and years all stay.\n"
    "2) Tables become Markdown tables without loss; a table that is too wide becomes several.\n"
    "3) Formulas stay in LaTeX, between $ or $$.\n"
    "4) A list, numbered or not, becomes an ordinary sentence.\n"
    "5) Keep the terms in the document's own language; translate and rephrase no value.\n"
    "6) Name no sources.\n"
    "7) Add nothing that the document doesn't say.\n"
    "8) Mark no headings with number signs.\n"
    "9) Write no escape sequences for line breaks.\n"
    "10) Where the same can be said better without losing any of it, say it better.\n"
    "11) End with a section of the entities to index (parameters, types, places, numbers with units), each as key: value."
)


def extraction_request(raw: Column, prompt: str = EXTRACTION_PROMPT, most: int = 400_000) -> Column:
    """What a model gets for a document: the raw text, capped, then the instruction."""
    return F.concat(F.lit("\n---\nRaw text:\n"), F.substring(raw, 1, most), F.lit("\n---\nInstruction:\n" + prompt))


class HttpBackend:
    """A local text-generation server: POST {model, prompt, system, stream, options} and read "response"."""

    def __init__(self, url: str = "http://localhost:11434/api/generate", model: str = "text-cleaner", system: str = CLEANING_PROMPT, seed: int = 42, timeout: float = 600.0) -> None:
        self.url, self.timeout = url, timeout
        self.fixed = {"model": model, "system": system, "stream": False, "options": {"seed": seed}}

    def __call__(self) -> Callable[[str], str]:
        def generate(text: str) -> str:
            request = urllib.request.Request(self.url, json.dumps(self.fixed | {"prompt": text}).encode(), {"Content-Type": "application/json"})  # noqa: S310
            with urllib.request.urlopen(request, timeout=self.timeout) as response:  # noqa: S310
                return json.load(response)["response"]

        return generate


class EchoBackend:
    """A deterministic stand-in: squeezes spaces, answers NOTHING to text without letters, and fails on a marker."""

    def __init__(self, fail_on: str | None = None, fail_times: int = 10**9) -> None:
        self.fail_on, self.fail_times = fail_on, fail_times

    def __call__(self) -> Callable[[str], str]:
        failed: dict[str, int] = {}

        def generate(text: str) -> str:
            if self.fail_on and self.fail_on in text and failed.get(text, 0) < self.fail_times:
                failed[text] = failed.get(text, 0) + 1
                raise RuntimeError("the model failed")
            return "```" + " ".join(text.split()) + "```" if any(c.isalpha() for c in text) else "NOTHING"

        return generate


def with_retries(call: Callable[[str], str], attempts: int = 3, multiplier: float = 1.0, least: float = 2.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """call, tried again after growing pauses; the last error is raised."""

    def run(text: str) -> str:
        for k in range(attempts):
            try:
                return call(text)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(max(least, min(most, multiplier * 2**k)))
        raise AssertionError

    return run


def apply_model(df: DataFrame, backend: Backend, text_col: str = "text", attempts: int = 3, pause: tuple[float, float, float] = (1.0, 2.0, 10.0)) -> DataFrame:
    """df with value and error: the backend's answer per row, or null and what went wrong. Null texts are not sent.

    The function is marked non-deterministic, so the optimizer never runs it twice for one row.
    """

    @F.pandas_udf("value string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retries(backend(), attempts, *pause)
        for batch in batches:
            values, errors = [], []
            for text in batch:
                value = error = None
                if text is not None:
                    try:
                        value = call(text)
                    except Exception as e:  # noqa: BLE001  one row's failure is no other's
                        error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    answered = df.withColumn("__answer", run.asNondeterministic()(F.col(text_col)))
    return answered.withColumn("value", F.col("__answer.value")).withColumn("error", F.col("__answer.error")).drop("__answer")


def cleaned_answer(answer: Column) -> Column:
    """An answer without its code fence, empty where the model says that nothing is left."""
    return blank_sentinel(strip_backticks(answer))


def model_clean(chunks: DataFrame, backend: Backend, text_col: str = "text", **more) -> DataFrame:
    """chunks with value (cleaned, "" where nothing is left) and error."""
    out = apply_model(chunks, backend, text_col, **more)
    return out.withColumn("value", cleaned_answer(F.col("value")))
