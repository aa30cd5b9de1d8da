"""Telephony audio as media columns: WAV bytes holding mu-law, A-law or IMA ADPCM, expanded to 16-bit PCM.

mu-law and A-law expand through 256-entry tables; ADPCM blocks are decoded by numpy across all blocks
of a batch at once, one nibble of every block at a time. PCM is resampled by a polyphase windowed sinc
and stored as little-endian 16-bit samples.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import clipped_batches, small_batches, table, tidied, with_fields

RATE = 8000
#: The format tags of WAV.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
#: Bytes of a mono ADPCM block: a header of 4, then two samples a byte.
BLOCK = 192
#: The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def write_wav(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with `data` as its samples, unchanged. ADPCM data come in whole blocks."""
    if codec == "adpcm":
        if len(data) % BLOCK:
            raise ValueError(f"ADPCM data come in blocks of {BLOCK} bytes")
        per = (BLOCK - 4) * 2 + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // per, BLOCK, 4, 2, per)
        samples = len(data) // BLOCK * per
    else:
        fmt, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0), len(data)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """codec, rate, block size and data of a mono WAV file of one of the three codecs; else ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            codec = {v: k for k, v in TAGS.items()}.get(fmt[0] if fmt else -1)
            if codec is None or fmt[1] != 1 or at + 8 + size > len(media):
                raise ValueError("not mono mu-law, A-law or ADPCM, or cut short")
            return codec, fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) uint8 to (blocks, samples) int16. A step index over 88 counts as 88."""
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty(((width - 4) * 2 + 1, n), dtype=np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (codes[k >> 1] >> (4 * (k & 1)) & 15).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def sinc_bank(up: int, down: int, half: int = 4) -> np.ndarray:
    """(up, 2 * half) taps of a Hann-windowed sinc, each phase summing to 1; a lower rate takes as many
    times more taps."""
    cut, half = min(1.0, up / down), half * max(1, -(-down // up))
    t = np.arange(2 * half) - (half - 1) - (np.arange(up) * down % up / up)[:, None]
    taps = np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, up: int, down: int, bank: np.ndarray) -> np.ndarray:
    """int16 samples at up / down times their rate; sample j stands at j * down / up of the old ones."""
    half, n = bank.shape[1] // 2, -(-len(pcm) * up // down)
    x = np.concatenate([np.zeros(half - 1, np.float32), pcm.astype(np.float32), np.zeros(half + down, np.float32)])
    out = np.empty(n, dtype=np.float32)
    for phase in range(min(up, n)):
        m, base = len(range(phase, n, up)), phase * down // up
        acc = np.zeros(m, np.float32)
        for k in range(2 * half):
            acc += bank[phase, k] * x[base + k :: down][:m]
        out[phase::up] = acc
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_bytes and media, in place of an own column named so: the text's UTF-8 bytes, filled
    with spaces to a positive multiple of BLOCK, as the samples of a WAV file whose codec follows the
    crc32 of those bytes. A null text is empty; each row, repeated or not, gets its own file, equal texts equal
    ones; ids don't matter. A text and its file must fit a task, whatever their length. An empty table gives no
    rows; other columns stay."""
    keep = [f for f in docs.schema.fields if f.name not in ("n_bytes", "media")]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in keep))
    schema = with_fields(docs, "n_bytes long", "media binary")

    def run(batches):
        for whole in batches:
            for batch in clipped_batches(whole):
                sizes, media = [], []
                for x in batch.column(text).cast(pa.binary()).to_pylist():
                    x = x or b""
                    payload = x.ljust(max(-(-len(x) // BLOCK), 1) * BLOCK)
                    sizes.append(len(x))
                    media.append(write_wav(CODECS[zlib.crc32(payload) % len(CODECS)], payload))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*batch.schema.names, "n_bytes", "media"])

    return small_batches(docs).mapInArrow(tidied(run), schema)


EXPANDED = "codec string, rate integer, payload binary, samples long, rms double, peak integer, crossings long, pcm_crc32 long, pcm binary, problem string"


def expand_media(rows: DataFrame, media: str = "media", rate: int = 16000, keep_pcm: bool = True) -> DataFrame:
    """rows without the media column, plus: codec, rate, payload (the stored data), samples, rms, peak,
    zero crossings and crc32 of the PCM resampled to `rate`, pcm (those samples; null unless keep_pcm)
    and problem (null, or why the media can't be read; then the others are null, as for null media).
    Own columns named as one of these are replaced, others stay; each row is read by itself, so repeated rows
    repeat the result and an empty table gives none. A file and its PCM must fit a task."""
    added = [x.split()[0] for x in EXPANDED.split(", ")]
    kept = [c for c in rows.columns if c not in added]
    rows = rows.select(*(F.col(f"`{c}`") for c in kept))
    schema = with_fields(rows.drop(media), *EXPANDED.split(", "))

    def one(codec: str, own: int, pcm: np.ndarray, banks: dict) -> list:
        g = np.gcd(rate, own)
        up, down = int(rate // g), int(own // g)
        if (up, down) not in banks:
            banks[up, down] = sinc_bank(up, down)
        pcm = resample(pcm, up, down, banks[up, down]) if up != down else pcm
        f = pcm.astype(np.float32)
        raw = pcm.astype("<i2").tobytes()
        rms = round(float(np.sqrt(np.dot(f, f) / max(len(f), 1))), 3)
        return [len(pcm), rms, int(np.abs(f).max(initial=0)), int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))), zlib.crc32(raw), raw if keep_pcm else None]

    def run(batches):
        banks: dict = {}
        for whole in batches:
            for batch in clipped_batches(whole, 2 << 20):  # the PCM is several times as large
                out, blocks = [[None] * len(added) for _ in range(batch.num_rows)], {}
                for i, x in enumerate(batch.column(media).to_pylist()):
                    if x is None:
                        continue
                    try:
                        codec, own, width, data = read_wav(x)
                        if codec == "adpcm" and (width < 5 or len(data) % width):
                            raise ValueError("broken ADPCM blocks")
                    except (ValueError, struct.error) as e:
                        out[i][-1] = str(e)
                        continue
                    out[i][:3] = codec, rate, data
                    data = np.frombuffer(data, np.uint8)
                    if codec == "adpcm":
                        blocks.setdefault(width, []).append((i, own, data.reshape(-1, width)))
                    else:
                        out[i][3:9] = one(codec, own, EXPAND[codec][data], banks)
                for parts in blocks.values():  # all blocks of one width at once
                    pcm = decode_adpcm(np.concatenate([p for _, _, p in parts]))
                    ends = np.cumsum([len(p) for _, _, p in parts])
                    for (i, own, _), part in zip(parts, np.split(pcm, ends[:-1])):
                        out[i][3:9] = one("adpcm", own, part.reshape(-1), banks)
                kept = [batch.column(c) for c in batch.schema.names if c != media]
                made = [pa.array(col, t) for col, t in zip(zip(*out) if out else [[]] * len(added), types)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*(c for c in batch.schema.names if c != media), *added])

    types = [{"string": pa.string(), "integer": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in EXPANDED.split(", ")]
    return small_batches(rows).mapInArrow(tidied(run), schema)


def feature() -> Column:
    return F.concat_ws(":", "codec", "rate", "samples", "rms", "peak", "crossings", "pcm_crc32")


def op7_telephony_audio(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = store_texts(docs).drop("text").withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2(F.col("media"), 256)})
    # the digest is of the PCM column, not of what the worker had
    out = expand_media(stored).withColumn("pcm_crc32", F.crc32("pcm"))
    tail = F.substring(F.col("payload"), -16, 16)
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", feature().alias("feature"),
    )
