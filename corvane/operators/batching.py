"""Batch generation: texts of like length go to a model together, within a budget of padded tokens."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.model import with_retries

#: A batch backend is a picklable factory: called once a task, it gives a function from texts to as many answers.
BatchBackend = Callable[[], Callable[[list[str]], list[str]]]
BUDGET, MOST_ROWS = 16_384, 64


def word_tokens(text: str) -> int:
    """White-space separated words and an end: a stand-in for a tokenizer's count."""
    return len(text.split()) + 1


def packed(lengths: list[int], budget: int, most_rows: int) -> Iterator[list[int]]:
    """Places of texts, batch by batch, shortest first: rows times the longest is at most budget; a text beyond it is a batch of its own."""
    batch: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        if batch and (len(batch) >= most_rows or lengths[k] * (len(batch) + 1) > budget):
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def answered(call: Callable[[list[str]], list[str]], texts: list[str]) -> Iterator[tuple[str | None, str | None]]:
    """(answer, error) of each text. A batch that fails is halved, down to the text that is at fault."""
    try:
        out = call(texts)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} answers to {len(texts)} texts")
        yield from ((x, None) for x in out)
    except Exception as e:  # noqa: BLE001  one row's failure is no other's
        if len(texts) == 1:
            yield None, f"{type(e).__name__}: {e}"
            return
        half = len(texts) // 2
        yield from answered(call, texts[:half])
        yield from answered(call, texts[half:])


def generate_in_batches(df: DataFrame, backend: BatchBackend, text_col: str = "text", budget: int = BUDGET, most_rows: int = MOST_ROWS, tokens: Callable[[str], int] = word_tokens, attempts: int = 3, pause: tuple[float, float, float] = (1.0, 2.0, 10.0)) -> DataFrame:
    """df with value, error, n_tokens and padded_tokens (the length of the longest text of its batch), answers in the rows that asked.

    The rows of an Arrow batch are dealt into model batches by length, so a task holds one Arrow batch and no row moves to another task. Null texts are not sent
    and have nulls; empty ones are. The function is marked non-deterministic, so the optimizer never runs it twice for a row.
    """
    if budget <= 0 or most_rows <= 0:
        raise ValueError("budget and most_rows must be positive")

    @F.pandas_udf("value string, error string, n_tokens long, padded_tokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retries(backend(), attempts, *pause, sleep=time.sleep)
        for series in batches:
            rows: list[tuple] = [(None, None, None, None)] * len(series)
            places = [k for k, text in enumerate(series) if text is not None]
            texts = [series.iloc[k] for k in places]
            lengths = [tokens(t) for t in texts]
            for batch in packed(lengths, budget, most_rows):
                most = lengths[batch[-1]]
                for k, (value, error) in zip(batch, answered(call, [texts[k] for k in batch]), strict=True):
                    rows[places[k]] = (value, error, lengths[k], most)
            out = pd.DataFrame(rows, columns=["value", "error", "n_tokens", "padded_tokens"])
            yield out.astype({"value": object, "error": object, "n_tokens": "Int64", "padded_tokens": "Int64"})

    done = df.withColumn("__answer", run.asNondeterministic()(F.col(text_col)))
    return done.withColumns({c: F.col(f"__answer.{c}") for c in ("value", "error", "n_tokens", "padded_tokens")}).drop("__answer")


def padding_share(generated: DataFrame) -> DataFrame:
    """One row: tokens, padded_tokens, and the share of these that is padding (null without any)."""
    sums = generated.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("padded_tokens"), F.lit(0)).alias("padded_tokens"))
    return sums.withColumn("padding", 1 - F.col("tokens") / F.nullif(F.col("padded_tokens"), F.lit(0)))


class EchoBatchBackend:
    """A deterministic stand-in: squeezes spaces, and fails a batch that holds a marker."""

    def __init__(self, fail_on: str | None = None) -> None:
        self.fail_on = fail_on

    def __call__(self) -> Callable[[list[str]], list[str]]:
        def generate(texts: list[str]) -> list[str]:
            if self.fail_on and any(self.fail_on in t for t in texts):
                raise RuntimeError("the model failed")
            return [" ".join(t.split()) for t in texts]

        return generate
