"""Telephony audio: companded and ADPCM samples in WAV files, expanded to resampled 16-bit PCM.

Mu-law and A-law expand by one 256-entry lookup table each, built from the companding rule. ADPCM blocks
are independent of each other, so a decoder walks the positions inside a block and decodes that position
of all blocks of a batch (of many files) at once with numpy. Decoded audio is resampled by linear interpolation and
stored as a PCM WAV file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the WAV format: format tags.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
# Fixed values of IMA ADPCM: the change of the step index by a code's three low bits.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Fixed values of IMA ADPCM: the step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)

RATE_IN, RATE_OUT = 8000, 16000
#: Data bytes of an ADPCM block, without its header of 4 bytes.
BLOCK_DATA = 64
#: Payloads are padded to a multiple of this.
UNIT = 64
#: Payload bytes that are decoded together.
BATCH_BYTES = 1 << 20


def mu_law_table() -> np.ndarray:
    """int16 of each mu-law code: sign, 3 bits of exponent, 4 of mantissa, all inverted; bias 33."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 1) + 33) << ((code >> 4) & 7)) - 33
    return (np.where(code & 0x80, -size, size) * 4).astype(np.int16)


def a_law_table() -> np.ndarray:
    """int16 of each A-law code: even bits inverted; sign, 3 bits of exponent, 4 of mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 0x0F
    size = np.where(exponent == 0, (mantissa << 1) + 1, ((mantissa << 1) + 33) << np.maximum(exponent - 1, 0))
    return (np.where(code & 0x80, size, -size) * 8).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks, 1 + 2 * data bytes) of mono IMA ADPCM blocks (blocks, 4 + data bytes)."""
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (data[k >> 1] >> (4 if k & 1 else 0)) & 0x0F
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def adpcm_blocks(payload: bytes) -> np.ndarray:
    """Blocks that hold the payload as their codes, each starting at value 0 and step index 0."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_DATA)
    blocks = np.zeros((len(data), 4 + BLOCK_DATA), np.uint8)
    blocks[:, 4:] = data
    return blocks


def wav(kind: int, data: bytes, rate: int = RATE_IN) -> bytes:
    """A mono WAV file."""
    bits, align = {PCM: (16, 2), A_LAW: (8, 1), MU_LAW: (8, 1), IMA_ADPCM: (4, 4 + BLOCK_DATA)}[kind]
    per_second = rate * align // (2 * BLOCK_DATA + 1) if kind == IMA_ADPCM else rate * align
    form = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits)
    if kind == IMA_ADPCM:
        form += struct.pack("<HH", 2, 2 * BLOCK_DATA + 1)
    elif kind != PCM:
        form += struct.pack("<H", 0)
    padded = data + b"\0" * (len(data) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + padded
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block align and the data of a WAV file; other chunks are skipped."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if form is None:
                raise ValueError("no format before the data")
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(media: bytes) -> bytes:
    """The sample codes of a telephony WAV file, as they were stored."""
    kind, _, align, data = parse_wav(media)
    if kind == IMA_ADPCM:
        return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()
    return bytes(data)


def expand(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Rate and int16 samples of each file; the ADPCM blocks of all files are decoded together."""
    parsed = [parse_wav(f) for f in files]
    out: list = [None] * len(files)
    coded = {}
    for k, (kind, rate, align, data) in enumerate(parsed):
        codes = np.frombuffer(data, np.uint8)
        if kind == IMA_ADPCM:
            coded.setdefault(align, []).append((k, codes.reshape(-1, align)))
        elif kind in (MU_LAW, A_LAW):
            out[k] = rate, (MU_TABLE if kind == MU_LAW else A_TABLE)[codes]
        elif kind == PCM:
            out[k] = rate, codes.view("<i2")
        else:
            raise ValueError(f"format {kind} isn't known")
    for own in coded.values():
        samples, at = decode_adpcm(np.concatenate([b for _, b in own])), 0
        for k, b in own:
            out[k] = parsed[k][1], samples[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def resample(samples: np.ndarray, rate: int, target: int = RATE_OUT) -> np.ndarray:
    """Linear interpolation to the target rate; the last sample is held."""
    if rate == target or not len(samples):
        return samples.astype(np.int16)
    if target == 2 * rate:
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        wide = samples.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    at = np.arange(len(samples) * target // rate, dtype=np.float64) * (rate / target)
    return np.rint(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def feature(pcm: np.ndarray, kind: int) -> str:
    """Format tag, samples, peak, root mean square, zero crossings and CRC of resampled PCM."""
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt((wide * wide).mean())) if len(pcm) else 0
    crossings = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
    return f"fmt={kind};n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};rms={rms};zc={crossings};pcm_crc={zlib.crc32(pcm.tobytes())}"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or UNIT * (not raw))


def store(payload: bytes) -> bytes:
    """The payload as a telephony file; the format follows from its CRC, so all three occur and equal payloads are equal files."""
    kind = (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    return wav(kind, adpcm_blocks(payload).tobytes() if kind == IMA_ADPCM else payload)


_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long"


def _groups(raw: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for x in raw:
        group.append(x)
        size += len(x)
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the columns of op5: each text's UTF-8 bytes stored as samples of a telephony file, read back and expanded.

    Null counts as empty, whose payload is 64 zero bytes. Repeated rows give a row each, equal texts equal
    values; an empty table gives an empty result; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            raw = batch.column(1).to_pylist()
            for group in _groups(raw):
                files = [store(padded(x)) for x in group]
                for x, media, (rate, samples) in zip(group, files, expand(files), strict=True):
                    back, kind = payload_of(media), parse_wav(media)[0]
                    pcm = wav(PCM, resample(samples, rate).tobytes(), RATE_OUT)
                    stored = np.frombuffer(parse_wav(pcm)[3], "<i2")
                    rows.append((len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(stored, kind), len(pcm)))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["id", *(c.split()[0] for c in _COLUMNS.split(", "))])

    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, f"id {id_type}, {_COLUMNS}").withColumnRenamed("id", id_col)


def expand_column(files: DataFrame, media_col: str = "media", pcm_col: str = "pcm", target_rate: int = RATE_OUT) -> DataFrame:
    """files with pcm_col: the telephony WAV bytes of media_col as a resampled PCM WAV file (null for null or unreadable files)."""
    kept = [c for c in files.columns if c != pcm_col]
    schema = files.select(kept).limit(0).withColumn(pcm_col, F.lit(None).cast("binary")).schema

    def one(media: bytes | None) -> bytes | None:
        try:
            rate, samples = expand([media])[0]
        except (TypeError, ValueError, struct.error):
            return None
        return wav(PCM, resample(samples, rate, target_rate).tobytes(), target_rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, media = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array([one(m) for m in media.to_pylist()], pa.binary())], names=[*kept, pcm_col])

    return files.select(*kept, F.col(media_col).alias("__media")).mapInArrow(run, schema)
