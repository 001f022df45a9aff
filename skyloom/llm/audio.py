"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded with numpy.

8-bit companded samples are expanded by lookup tables. ADPCM is decoded step by
step within a block, for all blocks of many recordings at once. Decoded sound is
resampled (upwards by linear interpolation, downwards by means over what a new
sample spans, which is the low-pass) and stored as 16-bit PCM. Wide numbers are
held for a bounded piece of a recording at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kind, utf8
from skyloom.scratch import store

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
RATE = 8_000
UNIT = 64
CODECS = (MU_LAW, A_LAW, IMA_ADPCM)
#: Recordings whose samples a task returns at a time, and samples or blocks for which it holds wide numbers.
ROWS, PIECE, BLOCKS = 256, 1 << 18, 1 << 12
#: zstd level of stored sound.
LEVEL = 12

# Fixed values of the IMA ADPCM format: step sizes, and what a 3-bit magnitude adds to the step's index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: the complement's sign, exponent and mantissa, with bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype("<i2")


def a_law_table() -> np.ndarray:
    """G.711 A-law: every second bit is inverted; the first two segments are linear."""
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype("<i2")


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of `block` bytes, each with a first sample and a step index; the last may be shorter."""
    if not data:
        return np.zeros(0, "<i2")
    n = -(-len(data) // block)
    short = len(data) - (n - 1) * block
    raw = np.frombuffer(data + bytes(n * block - len(data)), np.uint8).reshape(n, block)
    value = np.ascontiguousarray(raw[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(raw[:, 2].astype(np.int64), len(STEPS) - 1)
    codes = np.stack([raw[:, 4:] & 15, raw[:, 4:] >> 4], axis=2).reshape(n, -1)
    out = np.empty((n, codes.shape[1] + 1), np.int64)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k].astype(np.int64), STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.reshape(-1)[: (n - 1) * out.shape[1] + max(0, short - 4) * 2 + 1].astype("<i2")


def adpcm_encode(samples: np.ndarray, block: int) -> bytes:
    """IMA ADPCM blocks of the samples, all blocks at once; a short last block is filled with its last sample."""
    per = (block - 4) * 2 + 1
    if not len(samples):
        return b""
    n = -(-len(samples) // per)
    x = np.concatenate([samples, np.repeat(samples[-1:], n * per - len(samples))]).astype(np.int64).reshape(n, per)
    value, index = x[:, 0].copy(), np.zeros(n, np.int64)
    codes = np.zeros((n, per - 1), np.uint8)
    for k in range(1, per):
        step, gap = STEPS[index], x[:, k] - value
        code, rest, change = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = rest >= part
            code, rest, change = code + np.where(on, bit, 0), rest - np.where(on, part, 0), change + np.where(on, part, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, len(STEPS) - 1)
        codes[:, k - 1] = code
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    return np.concatenate([head, codes[:, 0::2] | codes[:, 1::2] << 4], axis=1).tobytes()


def wav(tag: int, data: bytes, rate: int = RATE, block: int = 256) -> bytes:
    """A mono WAV file of data in a format."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(tag, 8)
    align = {PCM: 2, IMA_ADPCM: block}.get(tag, 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == IMA_ADPCM else struct.pack("<H", 0)
    per_second = rate * bits // 8
    head = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"".join(
        name + struct.pack("<I", len(x)) + x + bytes(len(x) % 2) for name, x in ((b"fmt ", head), (b"fact", struct.pack("<I", len(data) * 8 // bits)), (b"data", data))
    )
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, int, int, int, bytes]:
    """Format tag, channels, rate, block size, bits and data of a WAV file; a ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            if min(size, len(media) - at - 8) < 16:
                raise ValueError("the format is cut off")
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data" and head:
            return head[0], head[1], head[2], head[4], head[5], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no sound in the file")


def understood(media: bytes) -> tuple[int, int, int, int, bytes]:
    """Format tag, channels, rate, block size and data of a WAV file that can be decoded; a ValueError for any other."""
    tag, channels, rate, block, bits, data = unwav(media)
    if not channels or not rate or {PCM: 16, MU_LAW: 8, A_LAW: 8, IMA_ADPCM: 4}.get(tag) != bits:
        raise ValueError("an unknown format")
    if tag == IMA_ADPCM and (channels > 1 or block < 5):
        raise ValueError("blocks of several channels or without sound")
    return tag, channels, rate, block, data


def adpcm_decode_all(parts: list[bytes], block: int) -> list[np.ndarray]:
    """Samples of each part. Whole blocks of all parts are decoded together, some thousand at a time."""
    whole = [len(x) // block * block for x in parts]
    data = b"".join(x[:n] for x, n in zip(parts, whole, strict=True))
    step, per = BLOCKS * block, (block - 4) * 2 + 1
    found = np.concatenate([adpcm_decode(data[at : at + step], block) for at in range(0, len(data), step)] or [np.zeros(0, "<i2")])
    ends = np.cumsum([n // block * per for n in whole])
    rest = [x[n:] for x, n in zip(parts, whole, strict=True)]
    return [np.concatenate([y, adpcm_decode(z, block)]) if len(z) else y for y, z in zip(np.split(found, ends[:-1]) if parts else [], rest, strict=True)]


def decoded(files: list[bytes]) -> list[tuple[np.ndarray, int] | None]:
    """16-bit samples and their rate for each file, several channels mixed into one; None for what can't be decoded."""
    out: list[tuple[np.ndarray, int] | None] = [None] * len(files)
    blocks: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, media in enumerate(files):
        try:
            tag, channels, rate, block, data = understood(media)
        except ValueError:
            continue
        if tag == IMA_ADPCM:
            blocks.setdefault(block, []).append((i, rate, data))
            continue
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2") if tag == PCM else {MU_LAW: MU, A_LAW: A}[tag][np.frombuffer(data, np.uint8)]
        if channels > 1:
            x = x[: len(x) // channels * channels].reshape(-1, channels)
            x = np.concatenate([x[at : at + PIECE].sum(axis=1, dtype=np.int64) // channels for at in range(0, len(x), PIECE)] or [x[:0, 0]]).astype("<i2")
        out[i] = x, rate
    for block, found in blocks.items():
        for (i, rate, _), x in zip(found, adpcm_decode_all([d for *_, d in found], block), strict=True):
            out[i] = x, rate
    return out


MU, A = mu_law_table(), a_law_table()


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at the new rate, in exact integer arithmetic, rounded down: linear interpolation upwards, the mean of what a new sample spans downwards. The last sample goes on past the end."""
    if rate == to or not len(samples):
        return samples
    n, step = -(-len(samples) * to // rate), max(1, PIECE * to // rate) if to > rate else PIECE
    out = np.empty(n, "<i2")
    for first in range(0, n, step):
        at = np.arange(first, min(n, first + step) + 1, dtype=np.int64) * rate
        low, part = at // to, at % to
        x = samples[low[0] : low[-1] + 2].astype(np.int64)
        x = np.concatenate([x, np.full(low[-1] + 2 - low[0] - len(x), samples[-1], np.int64)])
        low -= low[0]
        if to > rate:
            found = (x[low] + (x[low + 1] - x[low]) * part // to)[:-1]
        else:
            total = np.concatenate([[0], np.cumsum(x)])
            found = np.diff(total[low] * to + part * x[low]) // rate
        out[first : first + step] = found
    return out


def stored_audio(docs: DataFrame, payload: Column, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and `media`: each payload, padded with zero bytes to a positive multiple of 64, as a WAV file, stored and read back.

    The payload's CRC-32 deals it to mu-law, A-law or ADPCM in blocks of 64 bytes.
    Any bytes are valid data of these, so any payload survives. A null payload is
    empty, a null doc_id stays null. Rows that repeat get equal media. Other columns
    are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(payload, F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                media = [wav(CODECS[zlib.crc32(x) % len(CODECS)], bytes(x) + bytes(-len(x) % UNIT if x else UNIT), block=UNIT) for x in part["payload"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [len(x) for x in part["payload"]], "media": media})

    made = plain.mapInPandas(run, "doc_id string, n_bytes long, media binary")
    return store(made.withColumn("doc_id", F.col("doc_id").cast(kind(docs, doc_id))), "media", LEVEL)


def pcm_column(media: DataFrame, rate: int, column: str = "media", to: str = "pcm") -> DataFrame:
    """All columns and `to`, which takes the place of a column of that name: the column's WAV files as 16-bit little-endian samples at `rate`, to be stored by the caller.

    Null for null and for what is no WAV file of 16-bit PCM, mu-law, A-law or mono
    IMA ADPCM, cut-off formats included. Several channels are mixed into one. No
    rows give no rows.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = decoded([b"" if x is None else bytes(x) for x in batch])
            yield pd.Series([None if x is None else resample(*x, rate).tobytes() for x in found], dtype=object)

    return media.withColumn(to, F.pandas_udf(run, "binary").asNondeterministic()(F.col(column)))


def features_of(stored: bytes) -> str:
    """Mean power, zero crossings, peak and CRC-32 of 16-bit samples."""
    pcm, power, crossings, peak = np.frombuffer(stored, "<i2"), 0, 0, 0
    for at in range(0, len(pcm), PIECE):
        x = pcm[at : at + PIECE + 1].astype(np.int64)
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[:PIECE]
        power, peak = power + int((x * x).sum()), max(peak, int(np.abs(x).max()))
    return f"power={power // max(len(pcm), 1)};crossings={crossings};peak={peak};pcm_crc32={zlib.crc32(stored)}"


def audio_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE // 2) -> DataFrame:
    """Digests of the stored and reread audio of each row's text, and features of its PCM at `rate`, which is stored and reread too.

    A null or empty text is 64 zero bytes. Equal texts give equal values; rows that
    repeat stay. Columns beside the two named are not looked at. No rows give no
    rows.
    """
    media = stored_audio(docs, utf8(F.col(text)), doc_id)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(media: bytes) -> tuple:
            payload = unwav(media)[-1]
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()

        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                files = [bytes(x) for x in part["media"]]
                facts = pd.DataFrame([of(x) for x in files], columns=names, index=part.index)
                yield pd.concat([part[["doc_id", "n_bytes"]], facts.assign(pcm=[resample(*x, rate).tobytes() for x in decoded(files)])], axis=1)

    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features_of(bytes(x)) for x in batch], dtype=object)

    form = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    # Ids travel as text, which pandas keeps exact beside nulls.
    sound = media.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(digests, f"{form}, pcm binary")
    sound = store(sound, "pcm", LEVEL).withColumn("feature", F.pandas_udf(features, "string").asNondeterministic()(F.col("pcm"))).drop("pcm")
    return sound.withColumn("doc_id", F.col("doc_id").cast(kind(docs, doc_id)))
