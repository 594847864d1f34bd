"""Toxicity scores by a convolutional text classifier, learnt from all labelled documents.

A word's embedding joins a row of each of two hashed tables: one by the word, one by its first ``PREFIX`` bytes, which forms of a word share. Words and
beginnings that don't speak for toxicity by their numbers of documents are zero vectors. Filters of several widths run over the words, the highest response
of each over the whole text is kept (if positive), and a logistic unit weighs them. Its weights aren't negative: words can speak for toxicity only, so no
text scores below an empty one, and more text never lowers a score. Training is by Adagrad; only the words under a filter's highest response learn.

Learning reads each labelled text twice. The first pass counts the documents of each label that hold a word. The second one leaves of each text what
has embeddings, and counts equal remainders, which are few and short; these are dealt to blocks. In each of ``ROUNDS`` rounds the tasks sum the gradients of
their blocks, Spark adds these up by parameter, and the driver takes one step. Sums are of whole numbers, so a model depends on neither partitions nor order.

Thresholds are calibrated by language on all labelled documents: the one with the fewest errors, in the middle of the
widest gap. A text's language is the one whose function words are most frequent in it; texts of a language with too few labelled documents, and
those of none, take the threshold of all. The score is the logistic function of the distance to the threshold, so 0.5 is the
threshold in every language.

The model has a fixed size, which bounds what the driver holds. Scoring reads whole texts, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import LETTERS, pieces, scope, stage, text_or_empty

#: Different remainders of texts in a block, about, and bytes of their words.
TRAIN_DOCS, BLOCK_BYTES = 2_500, 4 << 20
#: Rows of an embedding table (a power of two), and values of a row; bytes of a word's beginning; widths of filters in words, filters of each.
TABLE_BITS, DIMENSIONS, PREFIX, WIDTHS, FILTERS = 17, 8, 5, (1, 2, 3), 16
#: What has an embedding: label 1 must have it in so many texts, in a share of its texts so many times that of label 0, and more often than chance by so many
#: deviations; and bits of the filter of these.
LEAST_TEXTS, LEAST_LIFT, LEAST_SIGMA, KNOWN_BITS = 4, 2.0, 4.0, 24
ROUNDS, RATE = 30, 0.1
#: Gradients are summed in units of 1 / UNIT, logits calibrated in steps of 1 / LOGIT_STEPS up to LOGIT_MOST.
UNIT, LOGIT_STEPS, LOGIT_MOST = 1 << 20, 256, 64
#: Labelled documents of each label that a language needs for its own threshold.
LEAST_LABELLED = 20
#: Places of words that a task counts at once.
COUNTED = 1 << 21
#: Words that are convolved at once.
WORDS = 1 << 15

# Frequent function words of the languages with thresholds of their own.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit auf ein eine einen dem den zu sich auch",
    "en": "the of and to is that was for with are this it from have which",
    "es": "el los las y que del una por con para es como más se su",
    "fr": "le les et des dans est une pour qui sur pas au avec ce sont",
    "it": "il di che è per della sono con gli nel anche dei alla",
    "pt": "o os não uma do da em para com são mais ao pelo",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_EDGE = max(WIDTHS) - 1
_ZERO = 1 << TABLE_BITS
_KNOWN = 1


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0


def word_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """uint32 hashes (n, 2) of a UTF-8 text's words and of their beginnings, in several arrays."""
    for piece in pieces(raw, LETTERS):
        words = piece.split()
        found = np.empty((len(words), 2), np.uint32)
        found[:, 0] = np.fromiter(map(crc32, words), np.uint32, len(words))
        found[:, 1] = np.fromiter([crc32(w[:PREFIX]) for w in words], np.uint32, len(words))
        yield found


def _place(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint32(32 - KNOWN_BITS)


def language_marks() -> np.ndarray:
    """For each place of the filter, the languages (from bit 1 on) that have it as a function word."""
    marks = np.zeros(1 << KNOWN_BITS, np.uint8)
    for k, lang in enumerate(LANGUAGES):
        marks[_place(np.array([crc32(w.encode()) for w in FUNCTION_WORDS[lang].split()], np.uint32))] |= np.uint8(2 << k)
    return marks


def language_counts(marks: np.ndarray) -> np.ndarray:
    """Function words of each language among the marks of a text's words."""
    return np.array([np.count_nonzero(marks & np.uint8(2 << k)) for k in range(len(LANGUAGES))])


def guessed(counts: np.ndarray) -> str:
    """The language of a text by its function words; empty without any."""
    return LANGUAGES[int(counts.argmax())] if counts.any() else ""


def compacted(hashes: np.ndarray, marks: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """tail and the table rows (n, 2) of the words after it; of a run of unknown words only as many as keep filters from reaching over it."""
    known = (marks & _KNOWN).astype(bool)
    rows = np.concatenate([tail, np.where(known, (hashes >> np.uint32(32 - TABLE_BITS)).astype(np.int64), _ZERO)])
    some = (rows != _ZERO).any(1)
    keep = some.copy()
    for k in range(1, _EDGE + 1):
        keep[k:] |= some[:-k]
    keep[: len(tail)] = True
    return rows[keep]


@dataclass
class Classifier:
    """The fitted model. known: packed bits of what has embeddings; thresholds: logits by language, '' for all others."""

    tables: np.ndarray  # (2, rows + 1, DIMENSIONS); the last row is zero
    filters: list[np.ndarray]  # of each width: (width, 2 DIMENSIONS, FILTERS)
    weights: np.ndarray
    bias: float
    known: np.ndarray
    thresholds: dict[str, float]

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[t, rows[:, t]] for t in range(2)], axis=1)

    def responses(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Of each width: the filters' responses at each start; vectors end with _EDGE zero ones."""
        n = len(vectors) - _EDGE
        return [sum(vectors[o : o + n] @ kernel[o] for o in range(width)) for width, kernel in zip(WIDTHS, self.filters, strict=True)]

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias


def untrained(seed: int = 1) -> Classifier:
    random = np.random.default_rng(seed)
    tables = random.normal(0, 0.1, (2, _ZERO + 1, DIMENSIONS)).astype(np.float32)
    tables[:, _ZERO] = 0
    filters = [random.normal(0, (w * 2 * DIMENSIONS) ** -0.5, (w, 2 * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights = np.abs(random.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
    return Classifier(tables, filters, weights, 0.0, np.zeros(1 << KNOWN_BITS - 3, np.uint8), {"": 0.0})


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several texts with _EDGE unknown ones before each and at the end, and the texts' starts."""
    edge = np.full((_EDGE, 2), _ZERO)
    return np.concatenate([x for t in texts for x in (edge, t)] + [edge]), np.cumsum([0, *(len(t) + _EDGE for t in texts[:-1])])


class Learning:
    """Adagrad on a model, in place. Its parameters are rows of DIMENSIONS numbers: those of the tables, then filters, weights and bias, one after the other."""

    def __init__(self, model: Classifier) -> None:
        self.model, self.dense = model, np.concatenate([*(f.ravel() for f in model.filters), model.weights, [model.bias]])
        self.squares = np.full_like(model.tables, 1e-6), np.full_like(self.dense, 1e-6)

    def step(self, keys: np.ndarray, sums: np.ndarray) -> None:
        """keys: of parameter rows; sums: their gradients over all documents, in units."""
        gradients = sums / UNIT
        dense, (tables, flat) = np.zeros(-(-len(self.dense) // DIMENSIONS) * DIMENSIONS), self.squares
        last = keys >= 2 * _ZERO
        for k, row in zip(keys[last] - 2 * _ZERO, gradients[last], strict=True):
            dense[k * DIMENSIONS : (k + 1) * DIMENSIONS] = row
        dense, (t, row), own = dense[: len(self.dense)], np.divmod(keys[~last], _ZERO), gradients[~last]
        tables[t, row] += own**2
        self.model.tables[t, row] -= RATE * own / np.sqrt(tables[t, row])
        flat += dense**2
        self.dense -= RATE * dense / np.sqrt(flat)
        n = len(self.model.weights)
        np.maximum(self.dense[-n - 1 : -1], 0, out=self.dense[-n - 1 : -1])
        at = 0
        for f in self.model.filters:
            f[:] = self.dense[at : at + f.size].reshape(f.shape)
            at += f.size
        self.model.weights[:], self.model.bias = self.dense[at:-1], float(self.dense[-1])


@dataclass
class Block:
    """Remainders of texts one after the other, each behind unknown words, and their labels, guessed languages and numbers of documents."""

    words: np.ndarray
    starts: np.ndarray
    labels: np.ndarray
    langs: list[str]
    n: np.ndarray

    @classmethod
    def of(cls, rows: pa.StructArray) -> Block:
        texts = [np.frombuffer(w, "<i4").reshape(-1, 2) for w in rows.field("words").to_pylist()]
        return cls(*joined(texts), rows.field("label").to_numpy(zero_copy_only=False).astype(np.float32), rows.field("lang").to_pylist(), rows.field("n").to_numpy(zero_copy_only=False))

    def peaks(self, model: Classifier, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The highest response of each filter in each text, and by width where it is first."""
        lengths = np.diff([*self.starts, len(vectors) - _EDGE])
        highest, places = [], []
        for r in model.responses(vectors):
            peak = np.maximum.reduceat(r, self.starts)
            at = np.where(r == np.repeat(peak, lengths, axis=0), np.arange(len(r), dtype=np.int32)[:, None], np.int32(len(r)))
            highest.append(peak)
            places.append(np.minimum.reduceat(at, self.starts))
        return np.concatenate(highest, axis=1), places

    def logits(self, model: Classifier) -> np.ndarray:
        return model.logit(np.maximum(self.peaks(model, model.vectors(self.words))[0], 0))

    def gradients(self, model: Classifier, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of parameter rows and their gradients in units, as Learning takes them. weights: of a document of either label."""
        vectors = model.vectors(self.words)
        peaks, at = self.peaks(model, vectors)
        pooled = np.maximum(peaks, 0)
        error = (1 / (1 + np.exp(-np.clip(model.logit(pooled), -30, 30))) - self.labels) * self.n * np.where(self.labels == 1, weights[1], weights[0])
        below = error[:, None] * model.weights * (peaks > 0)
        rows, gradients, dense = [], [], []
        for j, (width, kernel) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            g = below[:, j * FILTERS : (j + 1) * FILTERS]
            live = g != 0
            for o in range(width):
                dense.append(np.einsum("dfc,df->cf", vectors[at[j] + o], g).ravel())
                rows.append(self.words[at[j] + o][live])
                gradients.append((g[:, :, None] * kernel[o].T)[live])
        dense = np.concatenate([*dense, pooled.T @ error, [error.sum()]])
        dense = np.pad(dense, (0, -len(dense) % DIMENSIONS)).reshape(-1, DIMENSIONS)
        rows, gradients = np.concatenate(rows), np.concatenate(gradients)
        keys, sums = [2 * _ZERO + np.arange(len(dense))], [dense]
        for t in range(2):
            some, place = np.unique(rows[:, t], return_inverse=True)
            total = np.zeros((len(some), DIMENSIONS))
            np.add.at(total, place, gradients[:, t * DIMENSIONS : (t + 1) * DIMENSIONS])
            keys.append(t * _ZERO + some[some != _ZERO])
            sums.append(total[some != _ZERO])
        return np.concatenate(keys), np.rint(np.concatenate(sums) * UNIT).astype(np.int64)


def balanced(n: tuple[int, int]) -> tuple[float, float]:
    """Weights of a document of either label that make both labels count alike."""
    return sum(n) / (2 * n[0]), sum(n) / (2 * n[1])


def speaks_for(n0, n1, n: tuple[int, int]):
    """Whether what n0 and n1 texts of the labels have speaks for label 1; numbers, arrays or columns. n: all texts of the labels."""
    share = n[1] / sum(n)
    beyond = n1 - (n0 + n1) * share
    return (n1 >= min(LEAST_TEXTS, max(1, sum(n) // 20))) & (n1 * n[0] >= LEAST_LIFT * n0 * n[1]) & (beyond > 0) & (beyond * beyond >= LEAST_SIGMA**2 * (n0 + n1) * share * (1 - share))


def remainder(texts: Iterator[np.ndarray], marks: np.ndarray) -> tuple[bytes, str]:
    """What has embeddings of a text's hashed words, as table rows, and the text's guessed language."""
    tail, counts, kept = np.full((_EDGE, 2), _ZERO), np.zeros(len(LANGUAGES), np.int64), []
    for hashes in texts:
        own = marks[_place(hashes)]
        counts += language_counts(own[:, 0])
        words = compacted(hashes, own, tail)
        kept.append(words[_EDGE:])
        tail = words[len(words) - _EDGE :]
    words = np.concatenate(kept) if kept else tail[:0]
    ends = np.flatnonzero((words != _ZERO).any(1))
    return words[: ends[-1] + 1 if len(ends) else 0].astype("<i4").tobytes(), guessed(counts)


def constant(labels: set[int]) -> Classifier:
    """The model of labels of one kind or none, which tell nothing apart."""
    model = untrained()
    model.weights[:], model.bias = 0, 0.0
    model.thresholds = {"": -30.0 if labels == {1} else 30.0}
    return model


def thresholds(logits: np.ndarray, langs: np.ndarray, labels: np.ndarray, weights: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """By language, and of all. weights: how many documents an entry stands for; n: how many labelled ones it is."""
    found = {"": best_threshold(logits, labels, weights)}
    for lang in LANGUAGES:
        at = langs == lang
        if min(n[at & (labels == k)].sum() for k in (0, 1)) >= LEAST_LABELLED:
            found[lang] = best_threshold(logits[at], labels[at], weights[at])
    return found


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the least weight of errors; of equals, in the middle of the widest gap (a gap has 2 at most beyond the ends)."""
    order = np.argsort(logits, kind="stable")
    x, positive = logits[order], labels[order] == 1
    # errors of the cut before each place: positives below it, negatives above
    errors = np.concatenate([[0], np.cumsum(weights[order] * positive)]) + (weights[order] * ~positive).sum() - np.concatenate([[0], np.cumsum(weights[order] * ~positive)])
    low, high = np.concatenate([[x[0] - 2], x]), np.concatenate([x, [x[-1] + 2]])
    errors[high <= low] = np.inf
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    cut = best[np.argmax((high - low)[best])]
    return float((low[cut] + high[cut]) / 2)


def score_text(raw: bytes, model: Classifier, marks: np.ndarray) -> tuple[float, str]:
    """The logit and the guessed language of a whole text. marks: as marks_of() has them."""
    peaks, counts = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(LANGUAGES), np.int64)

    def convolve(words: np.ndarray) -> None:
        # each start but the last _EDGE, which the next words or the text's end follow
        for k in range(0, len(words) - _EDGE, WORDS):
            vectors = model.vectors(words[k : k + WORDS + _EDGE])
            np.maximum(peaks, np.concatenate([r.max(0) for r in model.responses(vectors)]), out=peaks)

    edge = tail = np.full((_EDGE, 2), _ZERO)
    for hashes in word_hashes(raw):
        own = marks[_place(hashes)]
        counts += language_counts(own[:, 0])
        words = compacted(hashes, own, tail)
        convolve(words)
        tail = words[len(words) - _EDGE :]
    convolve(np.concatenate([tail, edge]))
    return float(model.logit(peaks)), guessed(counts)


def marks_of(model: Classifier) -> np.ndarray:
    return language_marks() | np.unpackbits(model.known)


def fit_sample(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, calibrates: np.ndarray) -> Classifier:
    """The model of hashed texts at hand, as fit() learns it; weights: how many documents each stands for; calibrates: marks those for the thresholds."""
    if len(set(labels.tolist())) < 2:
        return constant({int(x) for x in labels})
    fits = ~calibrates
    if any(len(np.unique(labels[part])) < 2 for part in (fits, calibrates)):
        fits = calibrates = np.ones(len(labels), bool)  # too few documents for two parts
    n = tuple(int((labels[fits] == k).sum()) for k in (0, 1))
    model, counts = untrained(), np.zeros((2, 1 << KNOWN_BITS), np.int32)
    for k in np.flatnonzero(fits):
        counts[int(labels[k]), np.unique(_place(texts[k]))] += 1
    model.known = np.packbits(speaks_for(counts[0].astype(np.float64), counts[1].astype(np.float64), n))
    marks, learning = marks_of(model), Learning(model)

    def block(part: np.ndarray) -> Block:
        words, langs = zip(*(remainder(iter([texts[k]]), marks) for k in part), strict=True)
        return Block(*joined([np.frombuffer(w, "<i4").reshape(-1, 2) for w in words]), labels[part], list(langs), np.ones(len(part)))

    own, other = block(np.flatnonzero(fits)), block(np.flatnonzero(calibrates))
    for _ in range(ROUNDS):
        learning.step(*own.gradients(model, balanced(n)))
    model.thresholds = thresholds(other.logits(model), np.array(other.langs), other.labels, weights[calibrates], other.n)
    return model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, label, n): texts of a label whose words or beginnings fall on a place of the filter, added up by Spark."""

    def counted() -> pa.RecordBatch:
        some, n = np.unique(np.concatenate([x.astype(np.int64) * 2 + label for x, label in held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((some >> 1).astype(np.int32)), pa.array((some & 1).astype(np.int32)), pa.array(n.astype(np.int64))], names=["place", "label", "n"])

    held, size = [], 0
    for batch in batches:
        for raw, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            some = [np.unique(_place(h)) for h in word_hashes(raw)]
            if some:
                held.append((np.unique(np.concatenate(some)) if len(some) > 1 else some[0], label))
                size += len(held[-1][0])
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _known(rows: DataFrame, n: tuple[int, int]) -> np.ndarray:
    """The packed filter of what has embeddings, by the numbers of all texts (text, label)."""
    counts = rows.mapInArrow(_counts, "place int, label int, n long").groupBy("place").agg(*(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in (0, 1)))
    side = 1 << 15  # bits of one of Spark's bitmaps
    found = counts.filter(speaks_for(F.col("n0"), F.col("n1"), n)).groupBy(F.floor(F.col("place") / side).alias("k")).agg(F.bitmap_construct_agg(F.col("place") % side).alias("bits"))
    bits = np.zeros((1 << KNOWN_BITS) // side * (side // 8), np.uint8)
    for r in found.collect():  # 4 KB each, of 2 MB in all
        bits[r["k"] * (side // 8) : (r["k"] + 1) * (side // 8)] = np.frombuffer(r["bits"], np.uint8)
    return np.packbits(np.unpackbits(bits, bitorder="little"))


def _blocks(rows: DataFrame, model: Classifier, train_docs: int) -> DataFrame:
    """A table of blocks: in each row the remainders (words, label, lang) of some texts and n, how many documents have each."""
    at = rows.sparkSession.sparkContext.broadcast(model.known)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = language_marks() | np.unpackbits(at.value)
        for batch in batches:
            words, langs = zip(*(remainder(word_hashes(raw), marks) for raw in batch.column(0).cast(pa.binary()).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column(1), pa.array(langs, pa.string())], names=["words", "label", "lang"])

    kinds = stage(rows.mapInArrow(left, "words binary, label int, lang string").groupBy("words", "label", "lang").agg(F.count(F.lit(1)).alias("n")), "toxicity-remainders", narrow=True)
    size = kinds.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("words")).alias("bytes")).first()
    n = max(1, -(-size["rows"] // train_docs), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    dealt = kinds.groupBy(F.pmod(F.xxhash64("words", "label", "lang"), F.lit(n)).alias("block"))
    return stage(dealt.agg(F.sort_array(F.collect_list(F.struct("words", "label", "lang", "n"))).alias("rows")).select("rows"), "toxicity-blocks", narrow=True)


def _of_blocks(blocks: DataFrame, model: Classifier, make, schema: str, keys: list[str]) -> pa.Table:
    """make(block, model) of each block as record batches, whose other columns are added up by these keys."""
    at = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                yield make(Block.of(rows.values), at.value)

    made = blocks.mapInArrow(run, schema)
    found = made.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in made.columns if c not in keys)).toArrow()
    at.destroy()
    return found


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Classifier:
    """The classifier of all documents whose label isn't null and whose id isn't held out.

    An id with several labels has the highest; ids that are null, or in one table only, are left out; repeated documents train each. Null texts
    are empty ones. Labels of one kind or none give a model that scores every text alike (below 0.5, unless all labels are 1). train_docs: how many
    different texts are a block, about; a task holds one block at a time.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").filter(~held_out("id"))
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    with scope(documents.sparkSession) as tables:
        texts = documents.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text")).filter(~held_out("id"))
        # by a merge whatever the number of labels, so that no task holds them all
        rows = stage(texts.join(own.hint("merge"), "id").select("text", "label"), "toxicity-labelled")
        found = dict(rows.groupBy("label").count().collect())
        if len(found) < 2:
            tables.drop()
            return constant(set(found))
        n = found[0], found[1]
        model = untrained()
        model.known = _known(rows, n)
        blocks = _blocks(rows, model, train_docs)
        learning, weights = Learning(model), balanced(n)
        columns = [f"g{k}" for k in range(DIMENSIONS)]

        def gradients(block: Block, now: Classifier) -> pa.RecordBatch:
            keys, sums = block.gradients(now, weights)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(sums[:, k]) for k in range(DIMENSIONS))], names=["key", *columns])

        def logits(block: Block, now: Classifier) -> pa.RecordBatch:
            steps = np.rint(np.clip(block.logits(now), -LOGIT_MOST, LOGIT_MOST) * LOGIT_STEPS).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(block.langs, pa.string()), pa.array(block.labels.astype(np.int32)), pa.array(steps), pa.array(block.n)], names=["lang", "label", "steps", "n"])

        for _ in range(ROUNDS):
            sums = _of_blocks(blocks, model, gradients, f"key int, {', '.join(c + ' long' for c in columns)}", ["key"])
            learning.step(sums["key"].to_numpy(), np.stack([sums[c].to_numpy() for c in columns], axis=1))
        sums = _of_blocks(blocks, model, logits, "lang string, label int, steps int, n long", ["lang", "label", "steps"])
        counts = sums["n"].to_numpy()
        model.thresholds = thresholds(sums["steps"].to_numpy() / LOGIT_STEPS, sums["lang"].to_numpy(zero_copy_only=False), sums["label"].to_numpy(), counts.astype(np.float64), counts)
        tables.drop()
    return model


def score_columns(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """docs with score and predicted (1 from a score of 0.5 on), replacing columns of these names.

    Null texts score as empty ones. Repeated rows get equal values; an empty table gives an empty result; other columns pass through and are no input.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(kept).limit(0).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    for field in schema.fields:
        field.nullable = True
    at = docs.sparkSession.sparkContext.broadcast(model)  # some 11 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at.value
        marks = marks_of(own)
        for batch in batches:
            *columns, text = batch.columns
            scores = []
            for raw in text.cast(pa.binary()).to_pylist():
                logit, lang = score_text(raw, own, marks)
                scores.append(float(1 / (1 + np.exp(-np.clip(logit - own.thresholds.get(lang, own.thresholds[""]), -30, 30)))))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*kept, "score", "predicted"])

    return docs.select(*kept, text_or_empty(F.col(text_col)).alias("__text")).mapInArrow(run, schema)
