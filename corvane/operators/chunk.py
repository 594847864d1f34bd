"""Chunkers. Both fold over positions and lengths only, so a state is a few numbers and the bounds so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import chunk_id, squeeze_ws, strip

SENTENCE_LIMIT, OVERLAP_LIMIT, OVERLAP_WORDS = 1200, 1800, 10
_BOUNDS = "array<struct<s:int,e:int>>"


def sentence_pieces(text: Column) -> Column:
    """The non-blank parts between dots, stripped, each with a dot."""
    parts = F.transform(F.split(text, r"\.", -1), strip)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(p, F.lit(".")))


def _joined(items: Column, bounds: Column) -> Column:
    return F.transform(bounds, lambda b: F.array_join(F.slice(items, b["s"] + 1, b["e"] - b["s"]), " "))


def sentence_bounds(pieces: Column, limit: int) -> Column:
    """(s, e) of greedily packed chunks. A chunk is closed when its length plus the next piece exceeds the limit (the space between isn't counted)."""
    start = F.struct(F.array().cast(_BOUNDS).alias("done"), F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(a: Column, n: Column) -> Column:
        full = a["n"] + n > limit
        done = F.when(full, F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e"))))).otherwise(a["done"])
        length = F.when(full | (a["n"] == 0), n).otherwise(a["n"] + 1 + n)
        return F.struct(done.alias("done"), F.when(full, a["i"]).otherwise(a["s"]).alias("s"), (a["i"] + 1).alias("i"), length.alias("n"))

    return F.aggregate(F.transform(pieces, F.length), start, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e"))))).otherwise(a["done"]))


def chunk_by_sentences(df: DataFrame, text_col: str = "text", limit: int = SENTENCE_LIMIT, keep_empty: bool = False) -> DataFrame:
    """df without text_col, with chunk_idx (long) and text, a row per chunk.

    An oversized first sentence has an empty chunk before it, which is dropped unless keep_empty. A null or
    dotless blank text gives no chunks.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    rest = [c for c in df.columns if c not in (text_col, "chunk_idx", "text")]
    pieces = df.select(*rest, sentence_pieces(F.col(text_col)).alias("__pieces"))
    chunks = _joined(F.col("__pieces"), sentence_bounds(F.col("__pieces"), limit))
    if not keep_empty:
        chunks = F.filter(chunks, lambda c: c != "")
    return pieces.select(*rest, F.posexplode(chunks).alias("chunk_idx", "text")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


def words(text: Column) -> Column:
    return F.filter(F.split(squeeze_ws(text), " ", -1), lambda w: w != "")


def overlap_bounds(items: Column, limit: int, overlap: int) -> Column:
    """(s, e) of chunks of whole words; a word costs its length plus one, and a chunk's first word always fits.

    The next chunk repeats the last ``overlap`` words where the chunk has more than these and they leave room for the next word;
    otherwise it starts empty, so the fold always goes on.
    """
    start = F.struct(F.array().cast(_BOUNDS).alias("done"), F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(a: Column, cost: Column) -> Column:
        full = (a["n"] + cost > limit) & (a["i"] > a["s"])
        tail = F.aggregate(F.slice(items, a["i"] - overlap + 1, overlap), F.lit(0), lambda x, w: x + F.length(w) + 1) if overlap else F.lit(0)
        again = full & F.lit(overlap > 0) & (a["i"] - a["s"] > overlap)
        # the tail is only computed where a chunk closes
        kept = F.when(again, tail)
        fits = F.coalesce(kept + cost <= limit, F.lit(False))
        s = F.when(~full, a["s"]).when(fits, a["i"] - overlap).otherwise(a["i"])
        n = F.when(~full, a["n"] + cost).when(fits, kept + cost).otherwise(cost)
        done = F.when(full, F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e"))))).otherwise(a["done"])
        return F.struct(done.alias("done"), s.alias("s"), (a["i"] + 1).alias("i"), n.alias("n"))

    return F.aggregate(F.transform(items, lambda w: F.length(w) + 1), start, step, lambda a: F.when(a["i"] > a["s"], F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e"))))).otherwise(a["done"]))


def chunk_with_overlap(df: DataFrame, text_col: str = "text", limit: int = OVERLAP_LIMIT, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """df without text_col, with chunk_idx (long), id and text, a row per chunk of whole words."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    rest = [c for c in df.columns if c not in (text_col, "chunk_idx", "id", "text")]
    split = df.select(*rest, words(F.col(text_col)).alias("__words"))
    chunks = _joined(F.col("__words"), overlap_bounds(F.col("__words"), limit, overlap))
    out = split.select(*rest, F.posexplode(chunks).alias("chunk_idx", "text"))
    return out.select(*rest, F.col("chunk_idx").cast("long").alias("chunk_idx"), chunk_id(F.col("chunk_idx")).alias("id"), "text")


def with_offsets(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """chunks with start and end: character offsets in the chunks of a document joined by one space."""
    before = Window.partitionBy(doc_col).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return chunks.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
