"""Telephony audio as columns: G.711 and IMA ADPCM in WAV files, decoded with numpy, resampled and stored as PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.ship import frugal

# Format tags of WAV files, and the step sizes and index changes of IMA ADPCM.
PCM, A_LAW, MU_LAW, IMA = 1, 6, 7, 17
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def mu_law_table() -> np.ndarray:
    """PCM value of each mu-law code: all bits inverted, then sign, three bits of exponent and four of mantissa."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM value of each A-law code: every other bit inverted, then sign (set: positive), exponent and mantissa."""
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, (low + 264) << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def write_wav(kind: int, rate: int, data: bytes, channels: int = 1, bits: int = 8, block: int = 0, extra: bytes = b"") -> bytes:
    """A WAV file: format chunk (with the sample count for coded formats) and data chunk."""
    block = block or channels * bits // 8
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * block if kind != IMA else rate * block // max(1, (block - 4) * 2 + 1), block, bits)
    if kind != PCM:
        form += struct.pack("<H", len(extra)) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form
    if kind in TABLES:
        body += b"fact" + struct.pack("<II", 4, len(data) // channels)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes) -> tuple[int, int, int, int, bytes]:
    """Format, channels, rate, block size and data bytes. Chunks in any order; ValueError if it is no such file."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file[at + 8 : at + 24])
        elif name == b"data":
            data = file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAV file without format or data")
    if not form[1] or not form[2]:
        raise ValueError("a WAV file without channels or rate")
    if form[0] == IMA and form[5] != 4:
        raise ValueError(f"IMA ADPCM of {form[5]} bits")
    return form[0], form[1], form[2], form[4], data


def decode_ima(data: bytes, block: int, channels: int = 1) -> np.ndarray:
    """Samples of IMA ADPCM, frame by frame. Blocks do not depend on each other: each step handles all blocks at once.

    A block begins with four bytes for each channel, then channels take turns by four bytes. The last block may be
    short: its whole frames count. Bytes too few for its headers, or headers alone that are none (an index beyond 88), are
    left out.
    """
    if block <= 4 * channels:
        raise ValueError(f"blocks of {block} bytes for {channels} channels")
    whole = len(data) // block * block
    blocks, rest = np.frombuffer(data[:whole], dtype=np.uint8).reshape(-1, block), np.frombuffer(data[whole:], dtype=np.uint8)
    parts = [_ima_blocks(blocks, channels)]
    if len(rest) > 4 * channels or len(rest) == 4 * channels and (rest[2::4] <= 88).all():
        parts.append(_ima_blocks(rest.reshape(1, -1), channels))
    return np.concatenate(parts)


def _ima_blocks(blocks: np.ndarray, channels: int) -> np.ndarray:
    heads = blocks[:, : 4 * channels].reshape(len(blocks), channels, 4)
    value = heads[:, :, :2].copy().view("<i2")[:, :, 0].astype(np.int32)
    index = np.minimum(heads[:, :, 2].astype(np.int32), 88)
    body = blocks[:, 4 * channels :]
    turns, left = divmod(body.shape[1], 4 * channels)
    each = body[:, : turns * 4 * channels].reshape(len(blocks), turns, channels, 4).transpose(0, 2, 1, 3).reshape(len(blocks), channels, turns * 4)
    if (last := left - 4 * (channels - 1)) > 0:
        # A last turn that the last channel has but a part of.
        cut = np.stack([body[:, at : at + last] for at in range(turns * 4 * channels, turns * 4 * channels + 4 * channels, 4)], axis=1)
        each = np.concatenate((each, cut), axis=2)
    out = np.empty((len(blocks), 2 * each.shape[2] + 1, channels), dtype=np.int16)
    out[:, 0] = value
    for k in range(2 * each.shape[2]):
        code, step = (each[:, :, k // 2] >> 4 * (k % 2) & 15).astype(np.int32), IMA_STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767).astype(np.int32)
        index = np.clip(index + IMA_MOVES[code], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def decode(file: bytes) -> tuple[np.ndarray, int]:
    """PCM samples (rows: frames, columns: channels) and rate of a mu-law, A-law, IMA ADPCM or 8- or 16-bit PCM file."""
    kind, channels, rate, block, data = read_wav(file)
    if kind in TABLES:
        samples = TABLES[kind][np.frombuffer(data, dtype=np.uint8)]
    elif kind == IMA:
        samples = decode_ima(data, block, channels)
    elif kind == PCM and block == 2 * channels:
        samples = np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2")
    elif kind == PCM and block == channels:
        samples = (np.frombuffer(data, dtype=np.uint8).astype(np.int16) - 128) << 8
    else:
        raise ValueError(f"format {kind} in frames of {block} bytes")
    return samples[: len(samples) // channels * channels].reshape(-1, channels), rate


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """One channel at another rate by linear interpolation; doubling the rate, the common case, needs no positions."""
    if not len(samples) or rate == to:
        return samples.astype(np.int16)
    if to == 2 * rate:
        wide = samples.astype(np.int32)
        out = np.empty(2 * len(wide), dtype=np.int16)
        out[0::2] = wide
        out[1::2] = (wide + np.append(wide[1:], wide[-1:])) >> 1
        return out
    at = np.arange(len(samples) * to // rate) * (rate / to)
    return np.round(np.interp(at, np.arange(len(samples)), samples.astype(np.float64))).astype(np.int16)


def lift(pcm: np.ndarray) -> bytes:
    """16-bit samples for storage, without loss: their number, every other one, then how far those between lie from the mean of their
    neighbours, if any does. After doubling a rate none does. Arithmetic is modulo 2**16, so any samples can be stored.
    """
    even = pcm[0::2].astype(np.int32)
    rest = (pcm[1::2] - _between(even, len(pcm) // 2)).astype("<i2")
    return struct.pack("<I", len(pcm)) + even.astype("<i2").tobytes() + (rest.tobytes() if rest.any() else b"")


def unlift(stored: bytes) -> np.ndarray:
    n = int.from_bytes(stored[:4], "little")
    flat = np.frombuffer(stored, dtype="<i2", offset=4).astype(np.int32)
    even = flat[: n - n // 2]
    out = np.empty(n, dtype=np.int16)
    out[0::2] = even
    out[1::2] = _between(even, n // 2) + (flat[n - n // 2 :] if len(flat) == n else 0)
    return out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    return (even[:n] + np.append(even[1:], even[-1:])[:n]) >> 1


def describe(pcm: np.ndarray) -> str:
    """Peak, root mean square (to the nearest unit) and sign changes of the samples."""
    if not len(pcm):
        return "peak=0;rms=0;crossings=0"
    wide = pcm.astype(np.int64)
    negative = pcm < 0
    return f"peak={int(np.abs(wide).max())};rms={round(float(np.sqrt(np.dot(wide, wide) / len(wide))))};crossings={int(np.count_nonzero(negative[1:] != negative[:-1]))}"


MEDIA = "doc_id bigint, n_bytes bigint, media binary, pcm_rate int, pcm binary"
READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def store_as_telephony(docs: DataFrame, law: int = MU_LAW, rate: int = 8000, to_rate: int = 16000, pad_to: int = 192, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, padded with spaces, as the codes of a G.711 file (mu-law or A-law), and its resampled samples.

    `media` is the file, `pcm` the expanded and resampled 16-bit samples as `lift` stores them; both are to be written, and
    `digests` reads them. Codes map to samples by a table of 256 entries and are kept as they are, so storing loses
    nothing. Null and empty texts are `pad_to` spaces; null ids stay null; repeated rows repeat; other columns are
    not read. One pass, no shuffle.
    """

    @frugal
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            held = 0
            for doc, text_ in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text_.as_py() or "").encode()
                media = write_wav(law, rate, raw + b" " * ((-len(raw)) % pad_to if raw else pad_to))
                samples, own_rate = decode(media)
                pcm = lift(resample(samples[:, 0], own_rate, to_rate))
                for column, value in zip(rows, (doc.as_py(), len(raw), media, to_rate, pcm), strict=True):
                    column.append(value)
                held += len(media) + len(pcm)
                if held > 1 << 23:
                    yield _batch(rows, MEDIA)
                    rows, held = [[] for _ in range(5)], 0
            yield _batch(rows, MEDIA)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(store, MEDIA)


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(rows, types, strict=True)], list(names))


DECODED = "doc_id bigint, rate int, channels int, n_frames bigint, pcm_rate int, pcm binary, feature string, error string"


def decode_audio(files: DataFrame, to_rate: int = 16000, doc_id: str = "doc_id", audio: str = "media") -> DataFrame:
    """Each WAV file of a binary column (mu-law, A-law, IMA ADPCM, 8- or 16-bit PCM) as resampled 16-bit PCM.

    `pcm` has `n_frames` frames at `to_rate`, the samples of all channels in turn. A file that can't be read has its
    `error` and no samples; a null file has neither. Null ids stay null; repeated rows repeat. One pass, no shuffle.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            held = 0
            for doc, file in zip(batch.column(0), batch.column(1), strict=True):
                row = [doc.as_py(), *[None] * 7]
                if (raw := file.as_py()) is not None:
                    try:
                        samples, rate = decode(raw)
                        pcm = np.stack([resample(own, rate, to_rate) for own in samples.T], axis=1)
                        row[1:7] = rate, samples.shape[1], len(pcm), to_rate, pcm.astype("<i2").tobytes(), ";".join(map(describe, pcm.T))
                        held += pcm.nbytes
                    except (ValueError, struct.error) as error:
                        row[7] = str(error)
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
                if held > 1 << 24:
                    yield _batch(rows, DECODED)
                    rows, held = [[] for _ in range(8)], 0
            yield _batch(rows, DECODED)

    return files.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(audio).alias("audio")).mapInArrow(run, DECODED)


def digests(stored: DataFrame) -> DataFrame:
    """Sizes and check sums of stored files (`store_as_telephony`'s rows, written and read) and of the payload that the
    reader gets out of them, and the `feature` of the stored samples. One pass, no shuffle; only digests leave it.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, n, media, pcm in zip(*batch.columns, strict=True):
                file = media.as_buffer()
                payload = read_wav(file.to_pybytes())[4]
                row = (
                    doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                    file.size, hashlib.sha256(file).hexdigest(), describe(unlift(pcm.as_py())),
                )
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            yield _batch(rows, READ)

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, READ)
