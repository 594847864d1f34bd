"""Cross-entropy difference scoring with matched n-gram language models.

A target model (documents marked as wanted) and a background model (all documents) are bigram models over
one vocabulary, the words of all documents. Words and word pairs are counted as they are: each n-gram has its own
key, a hash and a bit that tells pairs from words. The hash has as many bits as the corpus needs: with ``SPARE`` more than
it takes to number the corpus's bytes, a key meets another n-gram's with a probability of about one in a million. Background counts are scaled to the target's
number of tokens, so both are smoothed alike. Each token's loss under both models gives a difference; the mean over
a document's tokens is its score (lower: more like the target).

The counts are a table in the shared folder that grows with the corpus: a row holds the sorted keys of one
range of hashes (a part). Texts are handled in blocks of about ``BLOCK`` bytes. A block sends each of its n-grams once to the
n-gram's part, however often it occurs, so a frequent n-gram has no more rows in a task than there are blocks. For
scoring, parts answer with the counts of a block's n-grams, and the answers meet the block's texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.minhash import chunks, mixed, word_hashes
from corvane.llm.shared import stage

#: Bytes of text of a block, and of all texts for each part (which sets the number of parts).
BLOCK, PART_BYTES = 1 << 23, 1 << 24
#: Weight of the unigram model in a bigram's estimate, and of the uniform one in a unigram's.
BACKOFF, FLOOR = 4.0, 0.5
#: Bits of a key beyond those that number the corpus's bytes.
SPARE = 20
_START = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_ONE = np.uint64(1)


def start_key(width: int) -> np.uint64:
    """The key of what stands before a text's first word; its count is that of the texts with words."""
    return np.uint64(_START >> np.uint64(64 - width) & ~_ONE)


def token_keys(texts: list[bytes], width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of all texts: keys (of width bits) of the token, of the token before and of the pair; and the offsets of the texts."""
    down = np.uint64(64 - width)
    own, before, pair, offsets = [], [], [], [np.zeros(1, np.int64)]
    for group in chunks(texts):
        ends = np.cumsum([len(t) + 1 for t in group])
        starts, hashes = word_hashes(b"\n".join(group) + b"\n")
        at = np.searchsorted(starts, np.concatenate([[0], ends]))
        previous = np.empty_like(hashes)
        previous[1:] = hashes[:-1]
        previous[at[:-1][np.diff(at) > 0]] = _START
        own.append(hashes >> down & ~_ONE)
        before.append(previous >> down & ~_ONE)
        pair.append(mixed(previous * _PAIR + hashes) >> down | _ONE)
        offsets.append(at[1:] + offsets[-1][-1])
    whole = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (own, before, pair)]
    return (*whole, np.concatenate(offsets))


def counted(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and for each the sum of its weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights))


def indexed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them (np.unique and searchsorted take several times as long)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return keys[new], at


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Byte planes of unsigned integers (rising: of their differences), compressed."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def unpacked(raw: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(raw[-8:], "little")
    planes = np.frombuffer(pa.decompress(raw[:-8], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def parts_of(keys: np.ndarray, width: int, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys of width bits, without empty ones."""
    part = (keys >> np.uint64(width - bits)).astype(np.int64)
    at = np.searchsorted(part, np.arange((1 << bits) + 1))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), slice(int(at[k]), int(at[k + 1]))


def key_bits(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The width of keys in bits, and the parts (as a power of two), for the texts of documents."""
    size = documents.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return min(64, size.bit_length() + SPARE), max(3, (size // PART_BYTES).bit_length())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.Array]]:
    """Texts of the first column in blocks, and the second column's values."""
    texts, held, size = [], [], 0
    for batch in batches:
        first = 0
        for k in range(batch.num_rows):
            texts.append(batch.column(0)[k].as_py())
            size += len(texts[-1])
            if size >= BLOCK:
                yield texts, pa.concat_arrays([*held, batch.column(1).slice(first, k + 1 - first)])
                texts, held, size, first = [], [], 0, k + 1
        held.append(batch.column(1).slice(first))
    if texts:
        yield texts, pa.concat_arrays(held)


def _raw(text_col: str):
    return F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw")


@dataclass
class MatchedModels:
    """Counts of both models: a table of parts, and the sums over it. The background's counts are scaled to the target's mass."""

    table: DataFrame  # part, keys, background, target
    bits: tuple[int, int]  # as key_bits() has them
    mass: tuple[int, int]  # tokens: background, target
    texts: tuple[int, int]  # texts with words
    words: int  # distinct words

    @property
    def scale(self) -> tuple[float, float]:
        return (self.mass[1] / self.mass[0] if all(self.mass) else 1.0), 1.0


def fit(documents: DataFrame, text_col: str = "text", target_col: str = "is_target", bits: tuple[int, int] | None = None) -> MatchedModels:
    """Both models from all documents; target_col marks the target's. bits: as key_bits() has them, by default of documents.

    Texts that are null, empty or blank add nothing; a null mark is none. Repeated rows count as often as they are there. An empty
    table gives models without counts; other columns are ignored, whatever their names.
    """
    bits = key_bits(documents, text_col) if bits is None else bits
    start_of, width = start_key(bits[0]), bits[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, flags in _blocks(batches):
            own, _, pair, offsets = token_keys(texts, width)
            wanted, n = np.array(flags.to_pylist(), bool), np.diff(offsets)
            full, of = n > 0, np.repeat(wanted, n)
            found = [(u, np.bincount(at, minlength=len(u)), np.bincount(at[of], minlength=len(u))) for u, at in (indexed(own), indexed(pair))]
            found.append((np.array([start_of]), np.array([full.sum()]), np.array([wanted[full].sum()])))
            keys, background, target = counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
            rows = [(k, packed(keys[at], True), packed(background[at]), packed(target[at])) for k, at in parts_of(keys, *bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "keys", "background", "target"])

    def add(part: pa.Table) -> pa.Table:
        columns = [[unpacked(x, k == 1) for x in part.column(k).to_pylist()] for k in range(1, 4)]
        keys, background, target = counted(*(np.concatenate(c) for c in columns))
        start, word = keys == start_of, (keys & _ONE) == 0
        word &= ~start
        sums = [int(x[at].sum()) for at in (word, start) for x in (background, target)]
        row = [part.column(0)[0].as_py(), packed(keys, True), packed(background), packed(target), *sums, int(word.sum())]
        return pa.table([[x] for x in row], schema=pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("keys", "background", "target")), *((n, pa.int64()) for n in sums_of)]))

    sums_of = ["mass_background", "mass_target", "texts_background", "texts_target", "words"]
    rows = documents.select(_raw(text_col), F.coalesce(F.col(target_col).cast("boolean"), F.lit(False)).alias("wanted"))
    kind = "part int, keys binary, background binary, target binary"
    table = stage(rows.mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind + "".join(f", {n} long" for n in sums_of)), "lm-counts")
    b, t, texts_b, texts_t, words = (x or 0 for x in table.agg(*(F.sum(n) for n in sums_of)).first())
    return MatchedModels(table.select("part", "keys", "background", "target"), bits, (b, t), (texts_b, texts_t), words)


def score(docs: DataFrame, models: MatchedModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, target_loss, background_loss, score (target minus background), means per token in nats.

    Texts without words (null, empty, blank) have 0 tokens and null losses and score. Repeated rows get equal
    values; an empty table gives an empty result; other columns are ignored. Without target documents the
    target model is the uniform one over the words of all documents and one for all others.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    bits, scale, mass, first, words = models.bits, models.scale, models.mass, models.texts, models.words + 1

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids in _blocks(batches):
            whole = b"".join(texts)
            lengths = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), held, lengths, pa.array([len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)], pa.binary())], names=["block", "ids", "lengths", "texts"])

    def keys_of(lengths: list[int], raw: bytes) -> tuple[np.ndarray, ...]:
        whole = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
        ends = np.cumsum(lengths)
        return token_keys([whole[e - n : e] for e, n in zip(ends.tolist(), lengths, strict=True)], bits[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lengths, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own, _, pair, _ = keys_of(lengths, raw)
                keys = np.sort(np.concatenate([own, pair]))
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
                rows = [(k, name, packed(keys[at], True)) for k, at in parts_of(keys, *bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["part", "block", "asked"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        known = [unpacked(held.column(k)[0].as_py(), k == 1) for k in (1, 2, 3)] if held.num_rows else [np.zeros(0, np.uint64)] * 3
        out = []
        for part, name, raw in zip(*(asked.column(k).to_pylist() for k in range(3)), strict=True):
            keys = unpacked(raw, True)
            at = np.searchsorted(known[0], keys)
            found = at < len(known[0])
            found[found] = known[0][at[found]] == keys[found]
            counts = np.zeros((2, len(keys)), np.uint64)
            for m in range(2):
                counts[m, found] = known[1 + m][at[found]]
            out.append((name, part, packed(counts[0]), packed(counts[1])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "background", "target"])

    def losses(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        ids = blocks.column(1).combine_chunks().flatten()
        own, before, pair, offsets = keys_of(blocks.column(2)[0].as_py(), blocks.column(3)[0].as_py())
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        (own_keys, at_own), (pair_keys, at_pair) = indexed(own), indexed(pair)
        place = np.argsort(np.concatenate([own_keys, pair_keys]))
        order = np.argsort(answers.column(1).to_numpy())
        starts = before == start_key(bits[0])
        means = []
        for m in range(2):
            raw = answers.column(2 + m)
            counts = np.empty(len(place))
            counts[place] = np.concatenate([np.zeros(0), *(unpacked(raw[int(k)].as_py()) for k in order)]) * scale[m]
            one, both = counts[at_own], counts[len(own_keys) :][at_pair]
            history = np.where(starts, first[m] * scale[m], np.roll(one, 1))
            p1 = (one + FLOOR) / (mass[m] * scale[m] + FLOOR * words)
            loss = -np.log((both + BACKOFF * p1) / (history + BACKOFF))
            mean = np.zeros(len(n))
            if len(full):
                mean[full] = np.add.reduceat(loss, offsets[full]) / n[full]
            means.append(mean)
        background, target = means
        columns = [pa.array(x, pa.float64(), mask=n == 0) for x in (target, background, target - background)]
        return pa.table([ids, pa.array(n.astype(np.int64)), *columns], names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    rows = docs.select(_raw(text_col), F.col(id_col).alias("id"))
    blocks = stage(rows.mapInArrow(block, f"block string, ids array<{id_type}>, lengths array<long>, texts binary"), "lm-blocks")
    asked = blocks.select("block", "lengths", "texts").mapInArrow(ask, "part int, block string, asked binary")
    answers = asked.groupBy("part").cogroup(models.table.groupBy("part")).applyInArrow(answer, "block string, part int, background binary, target binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(losses, f"id {id_type}, n_tokens long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", id_col)


def mark_targets(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, is_target) where targets lists the wanted ids; repeated and null ids there change nothing, a null id of docs is no target.

    Always a merge join: the ids grow with the corpus, so a broadcast that small tables would get doesn't show what large ones need.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    wanted = targets.select(F.col(id_col).alias("__wanted")).distinct().hint("merge")
    marked = rows.join(wanted, rows["__id"] == wanted["__wanted"], "left")
    return marked.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), F.col("__wanted").isNotNull().alias("is_target"))
