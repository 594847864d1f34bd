"""Training-order materialisation of token sequences.

Documents become sequences of a fixed number of tokens, the last one padded. A keyed Feistel network
permutes the sequence numbers 0..N-1; numbers that leave the range are walked along their cycle until they are
back in it, so every sequence gets one global slot and every slot one sequence. A shard is a range of slots and one plain file:
the record of slot s begins at byte (s - first_slot) * stride, so a training run reads shards one after the other and resumes at
any slot by a seek. A record is ``length`` little-endian ids and one zero word (Spark's record separator).

Two passes run over the texts. The first one counts the sequences of each block of rows and writes the index (which slot
holds which part of which document). The second one tokenises again, as that is cheaper than a further copy of all tokens on
disk, and sends each sequence to the range partition of its slot, which writes the shard's file. A block is a run of rows of one
input file, known by the file and its first row; sequences are numbered by file, row and part. So the order follows
from the stored table and the key, not from the way Spark splits it; with ``ordered`` it follows from ids and texts alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe
from corvane.llm.shared import new_folder, stage

LENGTH = 512
SHARD_SLOTS = 1 << 13
KEY = 0x5EED
FEISTEL_ROUNDS = 6
#: Bytes of ids in an Arrow batch.
BATCH = 4 << 20
#: Characters of texts that go to the own encoder, which takes runs of any length.
LONG_TEXT = 1 << 17

_U = np.uint64


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0..n-1 chosen by the key, applied to the numbers x."""
    half = _U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (_U(1) << half) - _U(1)
    keys = np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, FEISTEL_ROUNDS, dtype=np.uint64)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            f = right * _U(0x9E3779B97F4A7C15) + k
            f ^= f >> _U(31)
            f *= _U(0xBF58476D1CE4E5B9)
            f ^= f >> _U(29)
            left, right = right, left ^ (f & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= _U(n)]  # cycle-walking
    return out.astype(np.int64)


@dataclass(frozen=True)
class Tokens:
    """How texts become ids: load() runs on the workers and gives the function; all ids, the end token's too, lie below size."""

    load: Callable[[], Callable[[str], Sequence[int]]]
    size: int
    end: int

    @property
    def width(self) -> int:
        """Bytes of an id; the largest number of that width is the padding, so it must be no id."""
        return 2 if self.size < 1 << 16 else 4

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


def _utf8() -> Callable[[str], np.ndarray]:
    return lambda text: np.frombuffer(text.encode("utf-8"), np.uint8)


#: UTF-8 bytes as ids.
BYTES = Tokens(_utf8, 257, 256)


@lru_cache(maxsize=2)
def _byte_bpe(path: str) -> Callable[[str], Sequence[int]]:
    import tiktoken

    ranks, _ = bpe.byte_vocabulary(path)
    # without a run of white space the pattern's look-ahead has nothing to do, and the plain pattern is faster
    full, plain = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (bpe.PATTERN, bpe.PATTERN.replace(r"|\s+(?!\S)", "")))
    space = re.compile(r"\s\s").search

    def encode(text: str) -> list[int] | np.ndarray:
        if len(text) > LONG_TEXT:
            return bpe.encoder(path).encode_ordinary(text)
        runs = "  " in text if text.isprintable() else space(text)  # of white space, only the space is printable
        return (full if runs else plain).encode_ordinary(text)

    return encode


def byte_bpe(path: str) -> Tokens:
    """Ids of a byte-level BPE file, special tokens in texts as ordinary text; the end token is its first special token, or the next free id."""
    ranks, special = bpe.byte_vocabulary(path)
    end = next(iter(special.values()), max(ranks.values()) + 1)
    return Tokens(lambda: _byte_bpe(path), max(end, *ranks.values()) + 1, end)


@dataclass
class Shards:
    """A materialised order: shard files in a folder, and the index (slot, doc_id, part, n_tokens)."""

    spark: SparkSession
    folder: str
    n: int
    length: int
    shard_slots: int
    width: int
    key: int
    index: DataFrame
    _files: dict[int, str] | None = field(default=None, repr=False)

    @property
    def stride(self) -> int:
        return self.width * (self.length + 1)

    def files(self) -> dict[int, str]:
        """Paths by shard number."""
        if self._files is None:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            listed = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
            found = ((re.match(r"part-(\d+)-", s.getPath().getName()), s.getPath().toString()) for s in listed)
            self._files = {int(m[1]): path for m, path in found if m}
        return self._files


def _stored_rows(docs: DataFrame, id_col: str, text_col: str, ordered: bool) -> DataFrame:
    """(file, path, row, doc_id, text), where docs is a scan of Parquet files with projections and filters alone, or else of a copy of it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if not ordered and plan.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns and "parquet" in plan.toString():
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    else:
        copy = stage(rows.orderBy(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)) if ordered else rows, "token-rows")
        source = copy.select("doc_id", "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    return source.select(F.xxhash64("path").alias("file"), "path", "row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


class Blocks:
    """For each row of a task, in order, its block: the file, and the row at which this task began to read that part of the file."""

    def __init__(self) -> None:
        self.file, self.first, self.last = None, 0, -1

    def __call__(self, file: int, row: int) -> tuple[int, int]:
        if file != self.file or row <= self.last:
            self.file, self.first = file, row
        self.last = row
        return file, self.first


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Both passes must split files alike, though executors may come and go between them."""
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    if before is None:
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)


def materialise(docs: DataFrame, tokens: Tokens = BYTES, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> Shards:
    """Writes the shards of docs in the shared folder.

    Null and empty texts are one sequence with the end token alone; repeated rows are sequences of their own; null ids stay null;
    an empty table gives no shards; other columns are ignored. Each shard is made by one task from exactly its slots. An id that doesn't
    fit the tokens' size is an error. ordered: numbers follow the order of (id, text) instead of the table's, whatever the input's partitioning;
    rows with equal ids and texts can't be told apart and share their slots among themselves.
    """
    with _same_splits(docs.sparkSession):
        return _materialise(_stored_rows(docs, id_col, text_col, ordered), docs.schema[id_col].dataType.simpleString(), tokens, length, shard_slots, key)


def _materialise(rows: DataFrame, id_type: str, tokens: Tokens, length: int, shard_slots: int, key: int) -> Shards:
    spark = rows.sparkSession
    dtype, width, size, end = tokens.dtype, tokens.width, tokens.size, tokens.end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, places, block_of = tokens.load(), {}, Blocks()
        for batch in batches:
            firsts = [block_of(file, row) for file, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n = np.array([len(encode(text)) + 1 for text in batch.column(4).to_pylist()], np.int64)
            parts = -(-n // length)
            of = np.repeat(np.arange(len(n)), parts)
            part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            place = np.empty(len(of), np.int64)
            at = 0
            for block, k in zip(firsts, parts.tolist(), strict=True):
                begin = places.get(block, 0)
                place[at : at + k] = np.arange(begin, begin + k)
                places[block] = begin + k
                at += k
            first = np.array([f for _, f in firsts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of, mask=place > 0)), pa.array(first[of]), pa.array(place), batch.column(3).take(pa.array(of)), pa.array(part), pa.array(np.minimum(length, n[of] - part * length))],
                names=["file", "path", "first", "place", "doc_id", "part", "n_tokens"],
            )

    counted = stage(rows.mapInArrow(count, f"file long, path string, first long, place long, doc_id {id_type}, part long, n_tokens long"), "token-index")
    # one row for each scan task and file it has read; the block's first sequence holds the path
    starts: dict[tuple[int, int], int] = {}
    n = 0
    for r in counted.groupBy("file", "first").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).orderBy("path", "first").toLocalIterator():
        starts[r["file"], r["first"]] = n
        n += r["n"]
    at = spark.sparkContext.broadcast(starts)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = at.value
        for batch in batches:
            start = np.array([begin[b] for b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            slot = feistel(start + batch.column(2).to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[3:]], names=["slot", "doc_id", "part", "n_tokens"])

    index = counted.select("file", "first", "place", "doc_id", "part", "n_tokens").mapInArrow(slots, f"slot long, doc_id {id_type}, part long, n_tokens long")
    folder = new_folder(spark, "token-shards")
    made = Shards(spark, folder, n, length, shard_slots, width, key, index)
    if not n:
        made._files = {}
        return made

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, begin, numbers, block_of = tokens.load(), at.value, {}, Blocks()
        for batch in batches:
            number, records = [], []
            for file, row, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                block, ids = block_of(file, row), encode(text)
                parts = -(-(len(ids) + 1) // length)
                whole = np.full(parts * length, -1, np.int64)
                whole[: len(ids)] = ids
                whole[len(ids)] = end
                if int(whole.max()) >= size:
                    raise ValueError(f"the token id {whole.max()} isn't below {size}")
                raw = whole.astype(dtype).tobytes()
                first = numbers.get(block)
                first = begin[block] if first is None else first
                numbers[block] = first + parts
                for k in range(parts):
                    number.append(first + k)
                    records.append(raw[k * width * length : (k + 1) * width * length])
                    if len(records) * width * length >= BATCH:
                        yield dealt(number, records)
                        number, records = [], []
            yield dealt(number, records)

    def dealt(number: list[int], records: list[bytes]) -> pa.RecordBatch:
        slot = feistel(np.array(number, np.int64), n, key)
        return pa.RecordBatch.from_arrays([pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot), pa.array(records, pa.binary())], names=["shard", "slot", "record"])

    sent = rows.select("file", "row", "text").mapInArrow(cut, "shard int, slot long, record binary")
    # a range of slots is one partition, and its file has that partition's number
    ranged = sent.repartitionById(-(-n // shard_slots), "shard").sortWithinPartitions("slot")
    ranged.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0" * width).text(folder)
    return made


def read_slots(made: Shards, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, shard, byte_offset, n_tokens, ids_sha256 of the slots from start to stop, from the bytes of the files that hold them."""
    spark, stop = made.spark, made.n if stop is None else min(stop, made.n)
    shard_slots, stride, length, dtype = made.shard_slots, made.stride, made.length, f"<u{made.width}"
    schema = "slot long, shard long, byte_offset long, n_tokens long, ids_sha256 string"
    wanted = range(max(start, 0) // shard_slots, -(-stop // shard_slots)) if start < stop else range(0)
    if not wanted:
        return spark.createDataFrame([], schema)
    files = made.files()
    whole = len(wanted) == len(files)
    stored = spark.read.format("binaryFile").load(f"{made.folder}/part-*" if whole else [files[k] for k in wanted]).select(F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                raw = memoryview(batch.column(1)[k].as_buffer())
                first = shard * shard_slots
                lo, hi = max(start - first, 0), min(stop - first, len(raw) // stride)
                ids = np.frombuffer(raw, dtype).reshape(-1, length + 1)[lo:hi, :length]
                # the padding is no id
                n = [int(x) for k in range(0, len(ids), 1024) for x in np.count_nonzero(ids[k : k + 1024] != np.iinfo(dtype).max, axis=1)]
                shas = [hashlib.sha256(row[:m]).hexdigest() for row, m in zip(ids, n, strict=True)]
                places = np.arange(lo, hi, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places + first), pa.array(np.full(hi - lo, shard)), pa.array(places * stride), pa.array(n, pa.int64()), pa.array(shas, pa.string())], names=["slot", "shard", "byte_offset", "n_tokens", "ids_sha256"])

    return stored.mapInArrow(run, schema)


def seek_slots(made: Shards, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The ids of the slots from start to stop, one after the other, for a training run that can open the folder: a seek to the first one, then sequential reads."""
    from pyarrow.fs import FileSystem

    stop, files = made.n if stop is None else min(stop, made.n), made.files()
    slot = start
    while slot < stop:
        shard = slot // made.shard_slots
        system, path = FileSystem.from_uri(files[shard] if "://" in files[shard] else files[shard].replace("file:/", "file:///", 1))
        with system.open_input_file(path) as f:
            f.seek((slot - shard * made.shard_slots) * made.stride)
            for slot in range(slot, min(stop, (shard + 1) * made.shard_slots)):  # noqa: B007, PLW2901
                ids = np.frombuffer(f.read(made.stride), f"<u{made.width}")[: made.length]
                yield ids[ids != np.iinfo(ids.dtype).max]
        slot += 1


def token_output(docs: DataFrame, tokens: Tokens = BYTES, **more) -> DataFrame:
    """slot, shard, byte_offset, doc_id, part, n_tokens, ids_sha256 of every sequence: the index with what was read back from the shards' files."""
    made = materialise(docs, tokens, **more)
    return read_slots(made).join(made.index.drop("n_tokens"), "slot").select("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids_sha256")
