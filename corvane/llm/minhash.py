"""Near-dedup by MinHash with tensored banding, confirmed on full sets.

Shingle sets come from numpy over the bytes of a batch of texts. Documents with the same set form one class; only
its smallest id goes on. Two small collections of ``SIDE`` bands (``ROWS`` minhashes each) are computed
per class; every pair of a band of the first and one of the second collection is a table key, so ``SIDE ** 2`` tables
cost the minhashes of ``2 * SIDE`` bands. Two sets of similarity s meet in some table with the
probability (1 - (1 - s ** ROWS) ** SIDE) ** 2, which is 0.9994 at 0.8 with the values here.

Inside a bucket not all pairs are made. Every member is verified against one pivot of the bucket, and
components of verified links are computed. Where members other than the pivot still lie in different
components, an exact residual stage goes on: only shingles that two components share can link them, so a set with more than a fifth
of its own shingles unshared is out; the others meet a central pivot (the member with the largest
shared part), and what is still apart is found by a prefix join over the rarest shared shingles, which
misses no link. All links are verified on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.shared import scope, stage

SIDE, ROWS = 8, 2
PERCENT = 80
#: 64-bit words of a set's parity bitmap.
BITMAP = 16
#: Bytes of text that numpy handles at once, some forty times as many in its arrays.
CHUNK = 1 << 18

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_XOR = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_MUL = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = _BYTE[_LOWER]
_WORDS = [f"w{k}" for k in range(BITMAP)]
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _STEP
    h ^= h >> _U(29)
    h *= _BASE
    h ^= h >> _U(32)
    return h


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and a 64-bit hash of each lower-cased word."""
    text = np.frombuffer(raw, np.uint8)
    space = _SPACE[text]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.diff(starts, append=len(text))
    place = np.arange(starts[0], len(text), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), lengths)
    values = _CODE[text[starts[0] :]]  # 0 for white space
    place[space[starts[0] :]] = 0
    values *= powers(int(place.max()) + 1)[place]
    return starts, mixed(np.add.reduceat(values, starts - starts[0]))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets of the texts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts, hashes = word_hashes(b"\n".join(texts) + b"\n")
    at = np.searchsorted(starts, np.concatenate([[0], ends]))  # first word of each text
    count = np.diff(at)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        rolled = np.full(n, _U(words))
        for k in range(words):
            rolled *= _STEP
            rolled += hashes[k : k + n]
        rolled = mixed(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for k in range(len(texts)):
        c = int(count[k])
        if c >= words:
            own = rolled[at[k] : at[k] + c - words + 1].copy()
            own.sort()
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif c:  # too few words: the sequence as a whole, told apart from longer shingles by its length
            h = np.full(1, _U(c))
            for w in hashes[at[k] : at[k] + c]:
                h *= _STEP
                h += w
            own = mixed(h)
        else:
            own = rolled[:0]
        parts.append(own)
        offsets[k + 1] = offsets[k] + len(own)
    return np.concatenate(parts) if parts else rolled[:0], offsets


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def signatures(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, and its 2 * SIDE bands; zeros for empty sets."""
    n = len(offsets) - 1
    one, two, bands = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, 2 * SIDE), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return one, two, bands
    at = offsets[full]
    one[full] = np.add.reduceat(mixed(flat), at)
    two[full] = np.add.reduceat(mixed(flat ^ _STEP), at)
    for band in range(2 * SIDE):
        h = np.full(len(full), _U(band + 1))
        for k in range(band * ROWS, (band + 1) * ROWS):
            v = flat ^ _XOR[k]
            v *= _MUL[k]
            h *= _STEP
            h += np.minimum.reduceat(v, at)
        bands[full, band] = mixed(h)
    return one, two, bands


def _signature_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in chunks(batch.column(2).to_pylist()):
                flat, offsets = shingle_sets(group, words)
                one, two, bands = signatures(flat, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * (2 * SIDE)), pa.array(bands.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), batch.column(1).slice(done, len(group)), pa.array(np.diff(offsets)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["id", "digest", "n", "one", "two", "bands"])
                done += len(group)

    return run


def parity_bitmaps(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BITMAP) words in which each shingle toggles one bit: two bitmaps differ in no more bits than the sets in shingles."""
    n = len(offsets) - 1
    places = (flat >> _U(32)) % _U(64 * BITMAP) + np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets)) * _U(64 * BITMAP)
    odd = (np.bincount(places.astype(np.int64), minlength=n * 64 * BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, BITMAP)


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in chunks(batch.column(1).to_pylist()):
                flat, offsets = shingle_sets(group, words)
                sets = pa.array([flat[offsets[k] : offsets[k + 1]].tobytes() for k in range(len(group))], pa.binary())
                bits = parity_bitmaps(flat, offsets)
                bitmap = pa.StructArray.from_arrays([pa.array(bits[:, k]) for k in range(BITMAP)], names=_WORDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), pa.array(np.diff(offsets)), bitmap, sets], names=["id", "n", "bits", "shingles"])
                done += len(group)

    return run


def may_be_similar(a: str, b: str, percent: int):
    """False only for sets (columns n and bits of the aliases) that can't be similar, by their sizes and parity bitmaps."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.bits.{w}").bitwiseXOR(F.col(f"{b}.bits.{w}"))).cast("long") for w in _WORDS), F.lit(0).cast("long"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common) > 0


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    small = sets.select("id", "n", "bits")
    # sizes and bitmaps first: hardly any pair that isn't similar carries its sets
    likely = pairs.join(small.alias("x"), F.col("a") == F.col("x.id")).join(small.alias("y"), F.col("b") == F.col("y.id")).filter(may_be_similar("x", "y", percent)).select("a", "b")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = sets.schema["id"].dataType.simpleString()
    return likely.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, id, n, pivot) of all buckets with two or more classes; the pivot is the smallest id."""
    first = classes.filter("n > 0").select("id", "n", F.slice("bands", SIDE + 1, SIDE).alias("second"), F.posexplode(F.slice("bands", 1, SIDE)).alias("i", "x"))
    keys = first.select("id", "n", "i", "x", F.posexplode("second").alias("j", "y")).select(F.xxhash64("i", "j", "x", "y").alias("key"), "id", "n")
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").select("key", "pivot")
    return keys.join(shared, "key")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            shingles = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
            same = [pa.array([batch.column(c)[k].as_py()] * len(shingles), batch.column(c).type) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(shingles)], names=["id", "component", "n", "shingle"])


def shared_shingles(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component, n, shingle, held, shared): the shingles of apart (id, component) that two or more components hold.

    held: sets among apart that hold the shingle; shared: such shingles of the set.
    """
    kind = sets.schema["id"].dataType.simpleString()
    rows = sets.join(apart, "id").select("id", "component", F.col("n").cast("long").alias("n"), "shingles").mapInArrow(_shingle_rows, f"id {kind}, component {kind}, n long, shingle long")
    rows = stage(rows, "minhash-shingles")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle", "held")
    return rows.join(common, "shingle").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id")))


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, component) of buckets in which members other than the pivot lie in different components."""
    named = members.join(labels, members["id"] == labels["node"], "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("component"))
    open_keys = named.filter("id <> pivot").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return named.join(open_keys, "key").select("key", "id", "component")


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))


def residual_links(open_rows: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels after all links between members of open_rows (key, id, component) in different components."""
    least = lambda n: F.ceil(n * percent / 100)
    apart = stage(open_rows.select("id", "component").distinct(), "minhash-apart", narrow=True)
    shared = shared_shingles(apart, sets).filter(F.col("shared") >= least(F.col("n")))
    sizes = stage(shared.select("id", "n", "shared").distinct(), "minhash-central", narrow=True)
    # a central pivot for each bucket
    open_rows = open_rows.join(sizes, "id")
    central = open_rows.groupBy("key").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), F.col("id").alias("id"), F.col("component").alias("component"))).alias("top")).select("key", F.col("top.id").alias("to"), F.col("top.component").alias("to_component"))
    pairs = open_rows.join(central, "key").filter("component <> to_component").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
    labels = with_links(labels, verified(pairs, sets, percent))

    # what is still apart: a prefix join, exact for sets that share a shingle between components
    apart = apart.join(labels, apart["id"] == labels["node"], "left").select("id", F.coalesce(labels["component"], apart["component"]).alias("component"))
    shared = shared_shingles(stage(apart, "minhash-apart", narrow=True), sets).filter(F.col("shared") >= least(F.col("n")))
    order = Window.partitionBy("id").orderBy("held", "shingle")
    prefix = shared.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("shared") - least(F.col("n")) + 1)
    # of two sets the one that comes second by (n, id) can only be matched by the shorter prefix of the first
    inner = F.col("shared") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    prefix = prefix.select("id", "component", "n", "shared", "shingle", (F.col("place") <= inner).alias("inner")).join(sets.select("id", "bits"), "id")
    prefix = stage(prefix, "minhash-prefix")
    a, b = prefix.filter("inner").alias("a"), prefix.alias("b")
    near = (
        (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
        & ((100 + percent) * F.least("a.shared", "b.shared") >= percent * (F.col("a.n") + F.col("b.n")))
        & may_be_similar("a", "b", percent)
    )
    pairs = stage(a.join(b, near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "minhash-prefix-pairs", narrow=True)
    if pairs.isEmpty():
        return labels
    return with_links(labels, verified(pairs, sets, percent))


def _raw(text_col: str):
    return F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")


def labelled(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, n, component) of every row: a hash of its text, the size of its set, and its component's smallest id."""
    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("id"), _raw(text_col).alias("raw"))
    of_class = ["n", "one", "two"]
    with scope(docs.sparkSession) as tables:
        signed = raw.select("id", F.xxhash64("raw").alias("digest"), "raw").mapInArrow(_signature_rows(words), f"id {kind}, digest long, n long, one long, two long, bands array<long>")
        signed = stage(signed, "minhash-signatures")
        classes = signed.filter("n > 0 AND id IS NOT NULL").groupBy(*of_class).agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
        classes = stage(classes, "minhash-classes")
        members = stage(bucket_members(classes), "minhash-members")
        wanted = stage(members.select("id").distinct(), "minhash-wanted", narrow=True)  # its size decides how the texts meet it
        sets = stage(raw.join(wanted, "id", "left_semi").mapInArrow(_set_rows(words), f"id {kind}, n long, bits struct<{', '.join(w + ': long' for w in _WORDS)}>, shingles binary"), "minhash-sets")

        pairs = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        labels = components(verified(pairs, sets, percent))
        open_rows = stage(unresolved(members, labels), "minhash-open", narrow=True)
        if not open_rows.isEmpty():
            labels = residual_links(open_rows, labels, sets, percent)
        tables.drop("minhash-signatures", "minhash-classes", "cc-labels")

    own = classes.select(*of_class, F.col("id").alias("rep"))
    own = own.join(labels, own["rep"] == labels["node"], "left").select(*of_class, F.coalesce("component", "rep").alias("component"))
    found = signed.select("id", "digest", *of_class).join(own, of_class, "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return found.select("id", "digest", "n", component.alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per input row.

    A-Z is lower-cased; words are runs of other than ASCII white space. The set of a text is its distinct
    shingles of ``words`` words, or the whole sequence if it has fewer words. Texts are linked where
    100 * intersection >= percent * union; component_id is the smallest id that links reach. Null, empty and blank texts
    have no shingles and no links. A row with a null id has a null component and is kept. Repeated rows
    get equal values; an empty table gives an empty result; other columns are ignored.
    """
    found = labelled(docs, words, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns, of each component the rows with its smallest id.

    Nulls, empty texts and repeated rows are as in near_duplicates(): a row goes only if its own text is linked to a smaller id, so rows
    that share an id stay or go by their texts (different texts that both come first with that id share their links, though). An empty table gives an empty result; names of other columns don't matter.
    """
    found = labelled(docs, words, percent, id_col, text_col)
    lost = stage(found.filter("id <> component").select("id", "digest").distinct(), "minhash-lost")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.xxhash64(_raw(text_col)).alias("sum"))
    return rows.join(lost, (rows["own"] == lost["id"]) & (rows["sum"] == lost["digest"]), "left_anti").select("row.*")
