"""Truncation by the tokens of a pluggable tokenizer, on whole characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
#: A tokenizer is a picklable factory: called in the task, it gives a function from a text to its tokens' (start, end) in characters.
Tokenizer = Callable[[], Callable[[str], list[tuple[int, int]]]]


def words() -> Callable[[str], list[tuple[int, int]]]:
    """White-space separated words as tokens."""
    return lambda text: [m.span() for m in re.finditer(r"\S+", text)]


class VocabularyFile:
    """The tokenizer of a ``tokenizers`` JSON file, which is on every executor under that path; special tokens aren't added."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self) -> Callable[[str], list[tuple[int, int]]]:
        return _loaded(self.path)


@lru_cache(maxsize=2)
def _loaded(path: str) -> Callable[[str], list[tuple[int, int]]]:
    from tokenizers import Tokenizer as Library
    from tokenizers import processors

    library = Library.from_file(path)
    library.post_processor = processors.ByteLevel(trim_offsets=False)  # white space stays with its token
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text, add_special_tokens=False).offsets


def cut(offsets: list[tuple[int, int]], text: str, most: int) -> tuple[int, int]:
    """(characters, tokens) of the most of a text's tokens, up to ``most``, that end with a whole character (tokens of bytes may share one)."""
    if len(offsets) <= most:
        return len(text), len(offsets)
    n = most
    while n and offsets[n][0] < offsets[n - 1][1]:  # the next token has a part of this one's last character
        n -= 1
    return (offsets[n - 1][1] if n else 0), n


def truncate_tokens(df: DataFrame, tokenizer: Tokenizer = words, text_col: str = "text", most: int = SEQUENCE) -> DataFrame:
    """df with text_col cut to its first most tokens, n_tokens (of the cut) and truncated. Null texts stay null, with null columns; repeated rows get equal values."""
    if most < 0:
        raise ValueError("most must not be negative")

    @F.pandas_udf("text string, n_tokens long, truncated boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        offsets_of = tokenizer()
        for series in batches:
            rows = []
            for text in series:
                end, n = (None, None) if text is None else cut(offsets_of(text), text, most)
                rows.append((None, None, None) if text is None else (text[:end], n, end < len(text)))
            yield pd.DataFrame(rows, columns=["text", "n_tokens", "truncated"]).astype({"text": object, "n_tokens": "Int64", "truncated": "boolean"})

    done = df.withColumn("__cut", run(F.col(text_col)))
    return done.withColumns({text_col: F.col("__cut.text"), "n_tokens": F.col("__cut.n_tokens"), "truncated": F.col("__cut.truncated")}).drop("__cut")
