"""From chunks or conversations to training-ready tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import append_eos, page_marked, strip

#: The prompt of instruction tuning. Fixed value; its later lines are indented by four spaces.
ALPACA = (
    "Ниже приведена инструкция, описывающая задачу, и входные данные, предоставляющие дополнительный контекст. Напишите ответ, который соответствующим образом дополняет запрос.\n\n"
    "    ### Instruction:\n    {}\n\n    ### Input:\n    {}\n\n    ### Response:\n    {}"
)


def split_key(key: Column, seed: int) -> Column:
    """A null key hashes as the empty one."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")))


def train_test_split(df: DataFrame, key_col: str, test_size: float, seed: int = 3407) -> DataFrame:
    """df with split: exactly ceil(test_size * n) rows are "test", chosen by the md5 of key and seed, ties by key.

    Rows are compared with the hash of the last test row, which a distributed top-k finds over the two hash columns only; the table
    itself is neither sorted nor moved. Rows with equal keys get the same split, so with repeated keys the test set has the rows of the last
    key that begins within its size, all of them. Null keys count as one key, before all others. Independent of the partitioning.
    """
    if not 0 <= test_size <= 1:
        raise ValueError("test_size must be between 0 and 1")
    k = math.ceil(round(test_size * df.count(), 9))
    if k == 0:
        return df.withColumn("split", F.lit("train"))
    order = F.struct(split_key(F.col(key_col), seed).alias("h"), F.col(key_col).alias("k"))
    last_hash, last_key = _kth(df.select(order.alias("o")), k)
    kind = df.schema[key_col].dataType
    own, key = split_key(F.col(key_col), seed), F.col(key_col)
    tie = key.isNull() if last_key is None else key.isNull() | (key <= F.lit(last_key).cast(kind))
    test = (own < F.lit(last_hash)) | ((own == F.lit(last_hash)) & tie)
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def _kth(hashed: DataFrame, k: int, at_once: int = 200_000) -> tuple:
    """The k-th smallest (h, k), found by narrowing down hash prefixes, so that no sort of all rows is needed."""
    prefix, before = "", 0
    while True:
        own = hashed.filter(F.startswith("o.h", F.lit(prefix))) if prefix else hashed
        counts = {r["p"]: r["n"] for r in own.groupBy(F.substring("o.h", 1, len(prefix) + 2).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 256 rows at most
        for p in sorted(counts):
            if before + counts[p] >= k:
                prefix = p
                break
            before += counts[p]
        if counts[prefix] <= at_once or len(prefix) >= 32:
            row = hashed.filter(F.startswith("o.h", F.lit(prefix))).orderBy("o").offset(k - before - 1).limit(1).first()
            return row["o"]["h"], row["o"]["k"]


def with_eos(df: DataFrame, eos: str, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, append_eos(F.col(text_col), eos))


def _template(instruction: Column, context: Column, response: Column, eos: str) -> Column:
    a, b, c, d = ALPACA.split("{}")
    return F.concat(F.lit(a), instruction, F.lit(b), context, F.lit(c), response, F.lit(d + eos))


def instruct_format(turns: DataFrame, eos: str, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, text) from rows (conv_id, turn, role, text): the last turn of each role in the prompt, missing ones empty.

    One aggregation with map-side combine; a conversation's turns are never collected.
    """
    last = lambda role: F.coalesce(F.expr(f"max_by(text, turn) FILTER (WHERE role = '{role}' AND text IS NOT NULL)"), F.lit(""))
    roles = turns.groupBy(conv_col).agg(last("user").alias("u"), last("system").alias("s"), last("assistant").alias("a"))
    return roles.select(conv_col, _template(strip(F.col("u")), strip(F.col("s")), strip(F.col("a")), eos).alias("text"))


def instruct_format_nested(df: DataFrame, eos: str, conversations_col: str = "conversations") -> DataFrame:
    """The same from a column array<struct<role, content>>, without a shuffle."""
    last = lambda role: strip(F.coalesce(F.try_element_at(F.filter(F.col(conversations_col), lambda t: t["role"] == role), F.lit(-1))["content"], F.lit("")))
    return df.withColumn("text", _template(last("user"), last("system"), last("assistant"), eos))


def explode_conversations(df: DataFrame, conversations_col: str = "conversations", conv_col: str = "conv_id") -> DataFrame:
    return df.select(conv_col, F.posexplode(conversations_col).alias("turn", "t")).select(conv_col, "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"))


def not_done(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """sources without those in done (an anti-join): the resume step."""
    return sources.join(done.select(key).distinct(), key, "left_anti")


def non_empty_outputs(stored: DataFrame, key: str) -> DataFrame:
    """Keys of outputs with at least one chunk."""
    return stored.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(key)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order (a top-k, no full sort); 0 gives none."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, key_col: str, n: int = 2) -> DataFrame:
    """The first n rows of each split."""
    return head(df.filter("split = 'train'"), n, key_col).union(head(df.filter("split = 'test'"), n, key_col))


def joined_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text") -> DataFrame:
    """(doc, text): page-marked pages in order, stripped; a null page is an empty one."""
    marked = pages.select(doc_col, page_col, page_marked(F.col(page_col), F.col(text_col)).alias("marked"))
    return marked.groupBy(doc_col).agg(F.expr(f"listagg(marked, '') WITHIN GROUP (ORDER BY {page_col})").alias("text")).withColumn("text", strip(F.col("text")))


def text_of_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text") -> DataFrame:
    """(doc, text): the non-empty pages in order with newlines after them, white space squeezed."""
    full = pages.filter(F.length(text_col) > 0)
    joined = full.groupBy(doc_col).agg(F.expr(f"listagg(concat({text_col}, '\\n'), '') WITHIN GROUP (ORDER BY {page_col})").alias("text"))
    from corvane.functions.text import squeeze_ws

    return joined.withColumn("text", squeeze_ws(F.col("text")))


def prompt_grid(prompts: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """prompts with max_new_tokens: each prompt once with every limit. The limits are a literal, so no row moves."""
    return prompts.withColumn("max_new_tokens", F.explode(F.array(*map(F.lit, limits))))
