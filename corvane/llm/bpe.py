"""BPE encoding and decoding.

Encoding: an Aho-Corasick automaton over all token strings gives the leftmost-longest tokens of a
pre-token. By the theory of BPE a token sequence is the merge result exactly when each two neighbours are
compatible, i.e. encoding their concatenation gives those two tokens again; a pair is tested against the
merge table by unmerging both sides, and the answers are kept in a pair-compatibility table. Where
neighbours disagree, the encoder takes the next shorter token at that place or steps back; a bitmap of
end positions that are known to be dead keeps this linear in the text.

Decoding: one blob holds the bytes of all tokens and an offset table says where each begins; ids become
one gather.

Results equal those of the ``tokenizers`` library for a byte-level BPE file, added tokens included.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenisation pattern (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes, about, of each of the two generations of a memory; the older one is dropped when the newer is full.
MEMO_BYTES = 20 << 20
#: Longer pre-tokens aren't remembered: they hardly ever come again.
MEMO_LONGEST = 48
#: Bytes of an entry besides its key's and value's characters.
_ENTRY = 130
#: Punctuation that ends a word.
ENDS = frozenset(".,;:!?")
#: Ids that are gathered at once, so that a very long text needs no more memory.
BLOCK = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the byte-level format: printable Latin-1 stands for itself, the rest follows from U+0100."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A dict of bounded size in bytes that computes what it lacks; get through ``memo[key]``. Keys are strings or integers."""

    def __init__(self, make, most: int = MEMO_BYTES) -> None:
        super().__init__()
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def forget(self) -> None:
        self.old, self.size = {}, 0
        self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        text = type(key) is str
        if text and len(key) > MEMO_LONGEST:
            return value
        if self.size >= self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += _ENTRY + (len(key) + len(value) if text else 0)
        self[key] = value
        return value


def gather(blob: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The pieces blob[offsets[k]:offsets[k + 1]] of all keys, one after the other."""
    start = offsets[keys]
    length = offsets[keys + 1] - start
    end = np.cumsum(length)
    if not len(end):
        return blob[:0]
    at = np.arange(end[-1], dtype=np.int64)
    at += np.repeat(start - end + length, length)
    return blob[at]


def offset_table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=offsets[1:])
    return np.frombuffer(b"".join(pieces), np.uint8), offsets


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of a byte-level BPE file by their bytes, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_alphabet(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}, special


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file (tokenizer.json)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = [b""] * self.size
        for s, i in vocab.items():
            pieces[i] = to_bytes(s)
        for s, i in self.added.items():
            pieces[i] = s.encode()
        self.blob, self.offsets = offset_table(pieces)
        self.longest = max(map(len, pieces))  # bytes of the longest token
        self.length = np.diff(self.offsets).tolist()
        self.decimals, self.decimal_offsets = offset_table([b"%d," % i for i in range(self.size)])

        # rank: the order of merges; single bytes come first. Ids of this format are in that order.
        self.merged: dict[int, int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.rank = [-1] * self.size
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if self.rank[whole] < 0:
                self.merged[left * self.size + right] = whole
                self.halves[whole] = left, right
                self.rank[whole] = rank
        # the automaton works on str, so a byte is the character of the same number
        self.automaton = ahocorasick.Automaton()
        known: dict[int, bool] = {}
        names = {pieces[i].decode("latin-1"): i for i in vocab.values() if self._own(i, known)}
        for s, i in names.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.token_of = names
        self.shorter = {i: next((names[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in names), -1) for s, i in names.items()}
        # for each string that begins a token, the longest token that begins it
        self.best: dict[str, int] = {}
        for s in names:
            for k in range(1, len(s) + 1):
                if s[:k] in names:
                    self.best[s[:k]] = names[s[:k]]
                else:
                    self.best[s[:k]] = self.best[s[: k - 1]]

        self.find = regex.compile(PATTERN).findall
        self.spans = regex.compile(PATTERN).finditer
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.odd_space = regex.compile(r"\s \s").search
        self.beyond = regex.compile("[^\0-՗]").search
        self.pairs = Memo(self._compatible)
        self.words = Memo(self._word)
        self.units = Memo(self._unit)
        self.kinds: dict[str, str] = {}

    # -- encoding

    def _compatible(self, key: int) -> bool:
        """Whether two tokens can stand side by side: no merge across their border comes before their own merges."""
        left, right = divmod(key, self.size)
        limit = len(self.rank)  # only merges before this one happen while the border is as it is
        while True:
            whole = self.merged.get(left * self.size + right)
            if whole is not None and self.rank[whole] < limit:
                return False
            # undo the later of the two merges that made the tokens at the border
            if self.rank[left] > self.rank[right]:
                limit = self.rank[left]
                left = self.halves[left][1]
            elif self.rank[right] >= 0:
                limit = self.rank[right] + 1
                right = self.halves[right][0]
            else:
                return True

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian uint32."""
        raw = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        whole = self.token_of.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        ids = [i for _, i in self.automaton.iter_long(raw)]
        pairs, size = self.pairs, self.size
        last = ids[0]
        for i in ids[1:]:
            if not pairs[last * size + i]:
                ids = self._backtrack(raw)
                break
            last = i
        return array("I", ids).tobytes()

    def _own(self, token: int, known: dict[int, bool]) -> bool:
        """Whether encoding a token's own string gives that token; others can't appear in a result."""
        if token not in known:
            left, right = self.halves[token]
            if self.rank[token] < 0:
                known[token] = self.offsets[token + 1] - self.offsets[token] == 1
            else:
                known[token] = self._own(left, known) and self._own(right, known) and self._joins(left, right)
        return known[token]

    def _joins(self, left: int, right: int) -> bool:
        """Whether left and right would stand side by side until they merge into one."""
        whole = self.merged[left * self.size + right]
        limit, a, b = self.rank[whole], left, right
        # the border must see no earlier merge than this one
        while True:
            if self.rank[a] > self.rank[b]:
                limit = min(limit, self.rank[a])
                a = self.halves[a][1]
            elif self.rank[b] >= 0:
                limit = min(limit, self.rank[b] + 1)
                b = self.halves[b][0]
            else:
                return True
            found = self.merged.get(a * self.size + b)
            if found is not None and self.rank[found] < limit:
                return False

    def _backtrack(self, raw: str) -> list[int]:
        n, long, length, pairs, size, shorter, best, prefix = len(raw), self.longest, self.length, self.pairs, self.size, self.shorter, self.best, self.automaton.longest_prefix
        alive = bytearray(b"\1" * (n + 1))
        ids: list[int] = []
        at = 0
        near = raw[:long]
        token = best[near[: prefix(near)]]
        while True:
            if ids:
                key = ids[-1] * size
                while token >= 0 and not (alive[at + length[token]] and pairs[key + token]):
                    token = shorter[token]
            else:
                while token >= 0 and not alive[at + length[token]]:
                    token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                if at == n:
                    return ids
                near = raw[at : at + long]
                token = best[near[: prefix(near)]]
            else:  # nothing fits here: this position is dead, so the token before gets shorter
                alive[at] = 0
                token = ids.pop()
                at -= length[token]

    def _pretokens(self, text: str) -> list[str]:
        """Unicode's character classes differ between library versions; of those that could differ, the classes are learnt by asking."""
        if self.beyond(text) is None:
            return self.find(text)
        new = [c for c in set(text) if c > "՗" and unicodedata.category(c) == "Cn"]
        if not new:
            return self.find(text)
        like = text.translate({ord(c): self._kind(c) for c in new})
        return [text[m.start() : m.end()] for m in self.spans(like)]

    def _kind(self, c: str) -> str:
        """A character of the same class (letter, number, space, other) as the library has it for c."""
        if c not in self.kinds:
            from tokenizers.pre_tokenizers import ByteLevel

            parts = lambda s: len(ByteLevel(add_prefix_space=False).pre_tokenize_str(s))
            self.kinds[c] = "ա" if parts("a" + c) == 1 else "١" if parts("1" + c) == 1 else "§" if parts("!" + c) == 1 else " "
        return self.kinds[c]

    def _unit(self, unit: str) -> bytes:
        """Ids of a space with what follows until the next space."""
        if self.beyond(unit) is None:
            if unit.isalpha():
                return self._word(" " + unit)
            bare = unit[:-1]
            if unit[-1:] in ENDS and bare.isalpha():
                return self.units[bare] + self.words[unit[-1]]
        return b"".join(map(self.words.__getitem__, self._pretokens(" " + unit)))

    def _plain(self, text: str) -> bytes:
        if self.odd_space(text):
            return b"".join(map(self.words.__getitem__, self._pretokens(text)))
        # No space has white space on both sides, so a pre-token can begin, but not go on, at any space.
        head, *rest = text.split(" ")
        first = b"".join(map(self.words.__getitem__, self._pretokens(head))) if head else b""
        return first + b"".join(map(self.units.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, without added special tokens around it."""
        if self.added_split is None or not any(a in text for a in self.added):
            return np.frombuffer(self._plain(text), "<u4")
        parts = [self.added[p].to_bytes(4, "little") if p in self.added else self._plain(p) for p in self.added_split(text) if p]
        return np.frombuffer(b"".join(parts), "<u4")

    def forget(self) -> None:
        """Empties the memories, which fill again within a second of work, so that an idle worker is small."""
        for memory in (self.pairs, self.words, self.units):
            memory.forget()

    def encode_ordinary(self, text: str) -> np.ndarray:
        """Ids of the whole text, in which added tokens are ordinary text."""
        return np.frombuffer(self._plain(text), "<u4")

    # -- decoding

    def decode_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        for k in range(0, len(ids), BLOCK):
            yield gather(self.blob, self.offsets, ids[k : k + BLOCK]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.decode_blocks(ids)).decode("utf-8", "replace")

    def ids_sha256(self, ids: np.ndarray) -> str:
        """Of the decimal ids joined by commas."""
        digest = hashlib.sha256()
        for k in range(0, len(ids), BLOCK):
            block = gather(self.decimals, self.decimal_offsets, ids[k : k + BLOCK])
            digest.update(block if k + BLOCK < len(ids) else block[:-1])
        return digest.hexdigest()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    """One encoder for each file and Python worker."""
    return ByteBPE(path)


def forgetting(path: str, run):
    """run, after which the worker's encoder forgets."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            encoder(path).forget()
            pa.default_memory_pool().release_unused()

    return then


def bpe_columns(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again.

    Null counts as empty (no ids, the digest of nothing); repeated rows and ties give a row each; an empty
    table gives an empty result; other columns are ignored. ``path`` must exist on every worker.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            n, shas, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                n.append(len(ids))
                shas.append(codec.ids_sha256(ids))
                decoded.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with ids_col (array<int>), replacing a column of that name; nulls as in bpe_columns()."""
    return _with_column(docs, text_col, ids_col, "array<int>", _encode_batches(path))


def decode_column(docs: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """docs with text_col decoded from ids_col; a null array gives the empty text."""
    return _with_column(docs, ids_col, text_col, "string", _decode_batches(path))


def _encode_batches(path: str):
    def run(column: pa.Array) -> pa.Array:
        codec = encoder(path)
        ids = [codec.encode(text or "") for text in column.to_pylist()]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return run


def _decode_batches(path: str):
    def run(column: pa.Array) -> pa.Array:
        codec = encoder(path)
        return pa.array([codec.decode(np.array(x or [], np.int64)) for x in column.to_pylist()], pa.string())

    return run


def _with_column(docs: DataFrame, source: str, target: str, kind: str, make) -> DataFrame:
    kept = [c for c in docs.columns if c != target]
    schema = docs.select(kept).limit(0).withColumn(target, F.lit(None).cast(kind)).schema
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:at], make(columns[at])], names=[*kept, target])

    return docs.select(*kept, F.col(source).alias("__source")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids (array<int>), n_tokens, ids_sha256 and decoded_sha256, replacing columns of these names.

    The digests are those of bpe_columns(): of the ids and of the text that they decode to. Nulls as there.
    """
    added = {"token_ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(kept).limit(0).withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):  # ids take several times the room of their text's digests
                batch = whole.slice(start, 1000)
                *columns, text = batch.columns
                ids = [codec.encode(t or "") for t in text.to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                shas = pa.array([codec.ids_sha256(x) for x in ids], pa.string())
                back = pa.array([hashlib.sha256(codec.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.diff(offsets).astype(np.int64)), shas, back], names=[*kept, *added])

    return docs.select(*kept, F.col(text_col).cast("string").alias("__text")).mapInArrow(forgetting(path, run), schema)
