"""Language identification by a bit-sliced Bloom filter over character n-grams.

Each slot of the filter holds a bitmask of languages. An n-gram sets a language's bit in its slots; the AND
of its slots gives all languages that contain it at once. Per language the n-grams of a text whose mask
has the language's bit are counted (a popcount down the bit's column), corrected for the false positives that the
bit's fill rate predicts; the language with the highest corrected share decides.

Training sees at most about ``train_docs`` labelled rows of each language, drawn by a hash of the id, so a rare language is
learnt at every size of the table. N-grams that too few of a language's texts hold are left out. Prediction reads the whole text and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the n-grams, in characters of the lower-cased text in which all but letters is one space.
SIZES = (2, 3, 4)
#: Slots of the filter (a power of two), and hashes per n-gram.
SLOT_BITS = 21
HASHES = 2
#: Bound of the training sample of a language, in rows (as an expectation).
TRAIN_DOCS = 5_000
#: Texts of a language that must hold an n-gram, as a share. It also bounds the n-grams kept: a text of n letters has 3 n of them.
LEAST_SHARE = 0.002
#: Languages of one bitmask; further ones have masks of their own.
MASK_BITS = 63
#: Characters that are handled at once.
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.array([32], np.uint32)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L occurs (the pattern also finds other numerals)."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low[0])
    return table


_tables: dict[str, np.ndarray] = {}


def _mapped(text: str) -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = _letters()
    return np.take(_tables["letters"], np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip")


def codes_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of other characters as one space, spaces at both ends."""
    codes = np.concatenate([_SPACE, *(_mapped(text[k : k + BLOCK_CHARS]) for k in range(0, len(text), BLOCK_CHARS)), _SPACE])
    space = codes == 32
    keep = np.empty(len(codes), bool)
    keep[0] = True
    np.logical_not(space[1:] & space[:-1], out=keep[1:])
    return codes[keep]


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """uint64 hashes of all n-grams of a size."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= _MIX[0]
        h += wide[k : k + n]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def blocks_of(text: str) -> Iterator[np.ndarray]:
    """Codes of the whole text in blocks that overlap by one n-gram."""
    codes = codes_of(text)
    for k in range(0, len(codes), BLOCK_CHARS):
        yield codes[k : k + BLOCK_CHARS + max(SIZES) - 1]


@dataclass
class LanguageFilter:
    """The fitted filter: languages in bit order, slots (an array for each MASK_BITS languages), and per size the false-positive rates."""

    languages: list[str]
    prior: list[float]
    slots: list[np.ndarray]  # of uint8, 16, 32 or 64
    false_rate: np.ndarray  # (sizes, languages)

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << SLOT_BITS) - 1)
        places = [((hashes >> np.uint64(SLOT_BITS * k)) & low).astype(np.int64) for k in range(HASHES)]
        return [np.bitwise_and.reduce([slots[p] for p in places]) for slots in self.slots]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, languages) popcounts, and n-grams per size."""
        hits, n = np.zeros((len(SIZES), len(self.languages))), np.zeros(len(SIZES))
        for codes in blocks_of(text):
            for j, size in enumerate(SIZES):
                hashes = gram_hashes(codes[: BLOCK_CHARS + size - 1], size)
                n[j] += len(hashes)
                for w, masks in enumerate(self.masks(hashes)):
                    bits = range(min(MASK_BITS, len(self.languages) - w * MASK_BITS))
                    if len(bits) <= 8:
                        # every mask value once, then its bits
                        seen = np.bincount(masks, minlength=1 << len(bits))
                        found = [seen[np.arange(len(seen)) >> b & 1 == 1].sum() for b in bits]
                    else:
                        found = [np.count_nonzero(masks >> masks.dtype.type(b) & masks.dtype.type(1)) for b in bits]
                    hits[j, w * MASK_BITS : w * MASK_BITS + len(bits)] += found
        return hits, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the corrected share of the winner's n-grams. Ties go to the language with more training rows."""
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        hits, n = self.counts(text)
        share = (hits - n[:, None] * self.false_rate) / np.maximum(1.0, n[:, None] * (1 - self.false_rate))
        share = np.clip(share, 0.0, 1.0)
        # a size without n-grams says nothing; longer n-grams tell languages apart better
        weight = (n > 0) * np.array(SIZES, float)
        total = (share * weight[:, None]).sum(0) / max(weight.sum(), 1.0)
        best = max(range(len(total)), key=lambda b: (round(float(total[b]), 12), self.prior[b]))
        return self.languages[best], float(min(1.0, max(0.0, total[best])))


def filled(languages: list[str], sizes: list[float], grams: np.ndarray, masks: list[np.ndarray]) -> LanguageFilter:
    """The filter of n-gram hashes with their languages' masks."""
    all_slots = []
    low = np.uint64((1 << SLOT_BITS) - 1)
    fill = np.zeros(len(languages))
    for w, mask in enumerate(masks):
        bits = min(MASK_BITS, len(languages) - w * MASK_BITS)
        kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits <= most)
        slots = np.zeros(1 << SLOT_BITS, kind)
        for k in range(HASHES):
            np.bitwise_or.at(slots, ((grams >> np.uint64(SLOT_BITS * k)) & low).astype(np.int64), mask.astype(kind))
        fill[w * MASK_BITS : w * MASK_BITS + bits] = [np.count_nonzero(slots >> kind(b) & kind(1)) / len(slots) for b in range(bits)]
        all_slots.append(slots)
    return LanguageFilter(languages, sizes, all_slots, np.tile(fill**HASHES, (len(SIZES), 1)))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, id_col: str = "doc_id") -> LanguageFilter:
    """The filter of rows with a non-null text and lang, of any number of languages.

    A sample of about train_docs rows of each language is drawn by a hash of the id, so its size doesn't grow with the table; its
    n-grams are counted on the executors, and those that LEAST_SHARE of a language's sampled texts hold come to the driver
    with their languages' masks. Repeated rows count as often as they are there; a table without labels gives a filter that knows no language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    languages = sorted(n, key=lambda x: (-n[x], x))
    if not languages:
        return LanguageFilter([], [], [], np.zeros((len(SIZES), 0)))
    sizes = [float(min(n[x], train_docs)) for x in languages]
    share = 1 << 30
    drawn = [(x, k // MASK_BITS, 1 << k % MASK_BITS, int(share * min(1.0, train_docs / n[x])), max(2 if sizes[k] >= 20 else 1, int(LEAST_SHARE * sizes[k]))) for k, x in enumerate(languages)]
    known = spark.createDataFrame(drawn, "of string, word int, mask long, rate long, least long")
    sample = rows.join(F.broadcast(known.select("of", "rate")), F.col("lang") == F.col("of")).filter(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(share)) < F.col("rate"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per batch: how many texts of a language hold an n-gram
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = codes_of(text)
                for size in SIZES:
                    held.setdefault(lang, []).append(np.unique(gram_hashes(codes, size)))
            for lang, found in held.items():
                keys, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frequent = counted.join(F.broadcast(known.select("of", "word", "mask", "least")), (F.col("lang") == F.col("of")) & (F.col("n") >= F.col("least")))
    words = range(-(-len(languages) // MASK_BITS))
    found = frequent.groupBy("gram").agg(*(F.bit_or(F.when(F.col("word") == w, F.col("mask")).otherwise(0)).alias(f"mask{w}") for w in words)).toArrow()
    return filled(languages, sizes, found.column("gram").to_numpy().view(np.uint64), [found.column(f"mask{w}").to_numpy().view(np.uint64) for w in words])


def predict_columns(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, replacing columns of these names.

    Null texts and texts without a letter are "und" with score 0. Repeated rows get equal values; an empty
    table gives an empty result; other columns pass through. The model has a fixed size and goes to every task.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(kept).limit(0).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    for field in schema.fields:
        field.nullable = True
    at = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** SLOT_BITS slots of up to 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at.value
        for batch in batches:
            *columns, text = batch.columns
            found = [own.predict(t) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2


def fit_documents(docs: DataFrame) -> LanguageFilter:
    """The filter of the rows of documents that aren't held out; rows with a null id are learnt from, other nulls and repeated rows are as in fit()."""
    return fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
