"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAVE containers.

8-bit companded samples expand through lookup tables of 256 entries, built from the rule of
each code. ADPCM blocks are decoded with numpy across blocks: the steps inside a block depend
on each other, those of different blocks don't, so step k of every block runs at once.
Decoded sound can be resampled to another rate and stored as 16-bit PCM.

Nulls: null media decodes to null columns; an empty data chunk to zero samples. Bytes that are
not such a container raise an error with the reason. Long recordings are decoded in slices of
blocks. Repeated rows and further columns pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismlake import runtime

#: Fixed values of the WAVE format: registered codec numbers.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17

#: Fixed values of the IMA ADPCM code: change of the step index by the low three bits of a code.
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]

#: Fixed values of the IMA ADPCM code: quantizer steps.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]

BLOCK = 192
RATE = 8000
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@functools.cache
def expansion(codec: int) -> np.ndarray:
    """The 16-bit sample of each of 256 companded bytes."""
    code = np.arange(256)
    if codec == MULAW:
        code = ~code & 0xFF
        size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
        return np.where(code & 0x80, -size, size).astype(np.int16)
    code = code ^ 0x55
    segment, size = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, size + 8, size + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_adpcm(data: np.ndarray, block: int = BLOCK, blocks_at_once: int = 1 << 14) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks; a last short block is decoded as far as it goes."""
    steps, change = np.array(STEPS, np.int32), np.array(INDEX_CHANGE * 2, np.int32)
    short = len(data) % block
    rows = np.concatenate([data, np.zeros((block - short) % block, np.uint8)]).reshape(-1, block)
    out = []
    for at in range(0, len(rows), blocks_at_once):
        part = np.ascontiguousarray(rows[at : at + blocks_at_once])
        value = np.ascontiguousarray(part[:, :2]).view("<i2")[:, 0].astype(np.int32)
        index = np.minimum(part[:, 2], len(STEPS) - 1).astype(np.int32)
        codes = np.ascontiguousarray(part[:, 4:].T)
        sound = np.empty((1 + 2 * len(codes), len(part)), np.int16)
        sound[0] = value
        for k, byte in enumerate(codes):
            for half, code in enumerate((byte & 0x0F, byte >> 4)):
                step = steps[index]
                delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
                value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
                index = np.clip(index + change[code], 0, len(STEPS) - 1)
                sound[1 + 2 * k + half] = value
        out.append(sound.T.reshape(-1))
    sound = np.concatenate(out) if out else np.zeros(0, np.int16)
    if short:
        sound = sound[: len(sound) - 2 * (block - max(short, 4)) - (1 if short < 2 else 0)]
    return sound


def write_wave(data: bytes, codec: int, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A RIFF/WAVE file with one mono track."""
    bits, block = (4, BLOCK) if codec == ADPCM else (bits, block)
    per_block = 2 * (block - 4) + 1 if codec == ADPCM else 1
    extra = struct.pack("<HH", 2, per_block) if codec == ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate * block // per_block, block, bits) + extra
    pad = b"\0" * (len(data) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Codec, rate, block size and data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or at + 8 + size > len(media):
                raise ValueError("WAVE: no format before the data, or data cut short")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("WAVE: no data chunk")


def decode(codec: int, block: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if codec in (MULAW, ALAW):
        return expansion(codec)[raw]
    if codec == ADPCM:
        return decode_adpcm(raw, block)
    if codec == PCM:
        return np.frombuffer(data[: len(data) & ~1], "<i2")
    raise ValueError(f"codec {codec} isn't one of PCM, A-law, mu-law, IMA ADPCM")


def resample(sound: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to ``to`` samples a second, rounded to 16 bits."""
    if rate == to or not len(sound):
        return sound.astype(np.int16)
    n = len(sound) * to // rate
    # place of output i in units of 1/to input samples, in integers so that it is exact
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, (at % to).astype(np.int32)
    wide = np.append(sound, sound[-1]).astype(np.int64)
    return ((wide[left] * (to - part) + wide[left + 1] * part + to // 2) // to).astype(np.int16)


def features(sound: np.ndarray, rate: int, frame: int = 160) -> str:
    """Duration, level, zero crossings, loudest frame, and a checksum of the PCM bytes."""
    if not len(sound):
        return "samples=0"
    x = sound.astype(np.int64)
    frames = np.add.reduceat(x * x, np.arange(0, len(x), frame))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};ms={len(x) * 1000 // rate};mean={int(x.sum()) // len(x)};power={int((x * x).sum()) // len(x)};peak={int(np.abs(x).max())};zero={crossings};loudest={int(np.argmax(frames))};pcm={zlib.crc32(sound.astype('<i2').tobytes()):08x}"


def decode_media(df: DataFrame, media: str = "media", to_rate: int = 16000) -> DataFrame:
    """Add ``pcm`` (a 16-bit WAVE file at ``to_rate``), ``pcm_samples`` and ``feature`` to ``df``."""
    runtime.bounded_arrow_batches(df.sparkSession, 256)
    at = df.columns.index(media)

    def run(batches):
        for batch in batches:
            pcm, count, feature = [], [], []
            for data in batch.column(at).to_pylist():
                if data is None:
                    sound = None
                else:
                    codec, rate, block, body = read_wave(data)
                    sound = resample(decode(codec, block, body), rate, to_rate)
                pcm.append(None if sound is None else write_wave(sound.astype("<i2").tobytes(), PCM, to_rate, 16, 2))
                count.append(None if sound is None else len(sound))
                feature.append(None if sound is None else features(sound, to_rate))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pcm, pa.binary()), pa.array(count, pa.int64()), pa.array(feature, pa.string())], [*batch.schema.names, "pcm", "pcm_samples", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, pcm binary, pcm_samples long, feature string")


def text_media(docs: DataFrame) -> DataFrame:
    """Whole texts as telephony sound: doc_id, n_bytes, media.

    The payload (UTF-8, filled up with spaces to a positive multiple of a block) becomes the
    coded samples themselves. Its checksum picks mu-law, A-law or ADPCM, so equal texts get
    equal files and all three codes occur.
    """
    runtime.bounded_arrow_batches(docs.sparkSession)

    def store(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                payload = data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b" ")
                sizes.append(len(data))
                media.append(write_wave(payload, (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_digest(stored: DataFrame, to_rate: int = 16000) -> DataFrame:
    """Read stored media back: digests of payload and file, and features of the resampled sound."""

    def read(batches):
        for batch in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            parsed = [read_wave(m) for m in batch.column(2).to_pylist()]
            sounds: dict[int, np.ndarray] = {}
            adpcm = [i for i, p in enumerate(parsed) if p[0] == ADPCM]
            if adpcm:  # blocks of many rows at once: each payload is whole blocks
                sound = decode_adpcm(np.frombuffer(b"".join([parsed[i][3] for i in adpcm]), np.uint8))
                ends = np.cumsum([len(parsed[i][3]) // BLOCK * (2 * BLOCK - 7) for i in adpcm])
                sounds = dict(zip(adpcm, np.split(sound, ends[:-1])))
            for i, ((codec, rate, block, payload), media) in enumerate(zip(parsed, batch.column(2).to_pylist())):
                sound = sounds[i] if i in sounds else decode(codec, block, payload)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(resample(sound, rate, to_rate), to_rate))
                for k, v in zip(out, values):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {k: pa.array(v, pa.int64() if isinstance(v[0], int) else pa.string()) for k, v in out.items() if len(v)}) if len(parsed) else pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {k: pa.array([], pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for k in out})

    runtime.bounded_arrow_batches(stored.sparkSession, 500)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)


def text_media_digest(docs: DataFrame) -> DataFrame:
    return media_digest(runtime.stage_table(text_media(docs), "media", "zstd"))
