"""Importance resampling towards a target distribution, with an exact distributed selection of the highest scores.

Features are runs of ``NGRAM`` words, hashed into ``BUCKETS`` buckets. Occurrences by bucket in all documents and in all target texts give
each bucket's gain, the log ratio of the smoothed shares; an array of gains scores every document by its mean gain, and Gumbel noise
from a hash of the id turns the highest scores into a draw without replacement.

The draw finds its k-th key by radix selection. A key is (score down, id up); its digits are counted over the table of scores,
the digit that holds the k-th key narrows the range, and the next digit is counted within it: a round moves at most ``2 ** DIGIT_BITS`` sums.
Only rows up to the k-th key are sorted, by ranges, and a row's rank is its place in its range after all ranges before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import LETTERS_DIGITS, pieces, stage, text_or_empty

#: Words of a feature, buckets of features, and the seed of the noise.
NGRAM, BUCKETS, SEED = 1, 10_000, 2024
#: Documents take part from so many words on; so many percent of these are drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit of the selection: the sums that a round brings to the driver.
DIGIT_BITS = 12

def feature_buckets(raw: bytes, ngram: int = NGRAM, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all features of a UTF-8 text, in several arrays: runs of ngram words, joined by one space."""
    tail: list[bytes] = []
    for piece in pieces(raw, LETTERS_DIGITS):
        words = tail + piece.split()
        features = words if ngram == 1 else [b" ".join(words[k : k + ngram]) for k in range(len(words) - ngram + 1)]
        if features:
            yield (np.fromiter(map(crc32, features), np.uint32, len(features)) % np.uint32(buckets)).astype(np.int64)
        tail = words[len(words) - ngram + 1 :] if ngram > 1 else []


def word_count(raw: bytes) -> int:
    return sum(len(piece.split()) for piece in pieces(raw, LETTERS_DIGITS))


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences by bucket over all texts: each task sends at most a sum for each bucket. Null counts as no text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                for found in feature_buckets(raw, ngram, buckets):
                    sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    counted = texts.select(text_or_empty(F.col(text_col)).alias("text")).mapInArrow(count, "bucket int, n long")
    whole = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        whole[bucket] = n
    return whole


def gains(background: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio)) of the smoothed shares by bucket, in doubles."""
    s_all, t_all, n = float(background.sum()), float(target.sum()), len(background)
    ratios = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(background.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u uniform from the first 8 hex digits of sha256 of '<seed>:<id>'; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), text_or_empty(doc_id))
    h = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score of every document. Without features the weight is 0."""
    gain = gains(*(bucket_counts(df, col, ngram, buckets) for df, col in ((documents, text_col), (targets, target_col))))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                n = total = 0
                for found in feature_buckets(raw, ngram, buckets):
                    n += len(found)
                    total += int(gain[found].sum())
                words.append(n if ngram == 1 else word_count(raw))
                features.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    weighed = rows.mapInArrow(weigh, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def nth_smallest(rows: DataFrame, column: str, n: int) -> tuple[int, int]:
    """The n-th smallest value (from 1) of a long column without nulls, and how many rows are below it: radix selection, most significant digit first."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below, value = 0, F.col(column)
    while low < high:
        shift = max(0, (high - low).bit_length() - DIGIT_BITS)
        # in decimals, as a difference of longs may not fit one
        digit = F.call_function("div", value.cast("decimal(20,0)") - F.lit(low), F.lit(1 << shift).cast("decimal(20,0)"))
        counts = dict(rows.filter(value.between(low, high)).groupBy(digit.alias("digit")).count().collect())
        for found in sorted(counts):
            if below + counts[found] >= n:
                break
            below += counts[found]
        low, high = low + (found << shift), min(high, low + (found + 1 << shift) - 1)
    return low, below


def importance_sample(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that aren't drawn.

    Of the N documents with least_words words, the floor(percent N / 100) with the highest scores are ranked from 1 on; ties go to the
    smaller id (an integer), then to fewer features and the lower weight. Repeated rows take part each, with a rank of their own. A null text is
    an empty one; a null id comes after all others of its score. Empty tables give an empty result, and without target texts all
    gains come from the documents alone. Other columns are ignored, whatever their names.
    """
    # frozen with a number for each row, which parts repeated rows
    rows = scored(documents, targets, id_col, text_col, target_col, ngram, buckets, seed)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    columns = [F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score")]
    eligible = F.col("n_words") >= least_words
    k = rows.filter(eligible).count() * percent // 100
    if k == 0:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))

    keys = rows.filter(eligible).select((-F.col("score")).alias("down"), "doc_id")
    down, before = nth_smallest(keys, "down", k)
    at_score = keys.filter(F.col("down") == down)
    wanted, known = k - before, at_score.filter("doc_id IS NOT NULL")
    up_to = F.lit(True)
    if known.count() >= wanted:
        up_to = F.col("doc_id") <= nth_smallest(known, "doc_id", wanted)[0]
    # rows that tie on the k-th key are all sorted; those after the k-th stay undrawn
    drawn = eligible & ((F.col("score") > -down) | (F.col("score") == -down) & F.coalesce(up_to, F.lit(False)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    in_order = rows.filter(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    in_order = stage(in_order, "importance-drawn")
    # a place is the range's number and the row's number in it
    sizes = dict(in_order.groupBy(F.shiftright("place", 33).alias("range")).count().collect())
    ranges = sorted(sizes)
    starts = dict(zip(ranges, accumulate([0] + [sizes[r] for r in ranges[:-1]]), strict=True))
    first = F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair))
    rank = F.element_at(first, F.shiftright("place", 33)) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = in_order.select(*columns, F.when(rank <= k, rank).alias("rank"))
    return ranked.unionByName(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


_CODES = "list_transform(range(0, length(hex(encode(word))) // 2), lambda k: ('0x' || substring(hex(encode(word)), 2 * k + 1, 2))::BIGINT)"
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
#: The same with SQL's window over all rows; the CRC from its table of 256 remainders.
ORACLE = f"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, {_STEP}, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, {{words}} AS words FROM documents),
goal AS (SELECT {{words}} AS words FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM docs UNION ALL SELECT unnest(words) FROM goal)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, {_CODES}), lambda crc, x: xor(crc // 256, t[xor(crc % 256, x) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM vocabulary, remainders),
own AS (SELECT r, bucket FROM (SELECT r, unnest(words) AS word FROM docs) JOIN hashed USING (word)),
s AS (SELECT bucket, count(*) AS s FROM own GROUP BY ALL),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(words) AS word FROM goal) JOIN hashed USING (word) GROUP BY ALL),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + {BUCKETS}) / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {BUCKETS}))))::HUGEINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, count(*) AS n, sum(gain)::HUGEINT AS total FROM own JOIN gains USING (bucket) GROUP BY ALL),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, (CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END)::BIGINT AS weight,
    ('0x' || substring(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN weights USING (r)),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features, weight) AS place FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM noisy WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank FROM placed
""".format(words=r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
