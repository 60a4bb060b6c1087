"""CRC-32C of many byte ranges at once, in numpy.

A register that starts at zero ignores leading zero bytes, so each range is cut into blocks
of equal size (the first one filled up in front), the blocks run in parallel, and their
registers are moved to the end of the range by the linear map "append zero bytes".
"""

from __future__ import annotations

import functools

import numpy as np

POLY = 0x82F63B78  # Castagnoli, reflected
BLOCK = 256
MASK_DELTA = 0xA282EAD8  # of the masked checksums in length-delimited record files


@functools.cache
def _byte_table() -> np.ndarray:
    """The register after one byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    return t


@functools.cache
def _word_tables() -> np.ndarray:
    """Two tables of 65536: the register after four bytes is one entry of each, combined."""
    t = _byte_table()
    step = lambda x: t[x & 0xFF] ^ (x >> 8)
    low = np.arange(65536, dtype=np.uint32)
    high = low << np.uint32(16)
    for _ in range(4):
        low, high = step(low), step(high)
    return np.stack([low, high])


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 0xFF] ^ tables[1][(x >> 8) & 0xFF] ^ tables[2][(x >> 16) & 0xFF] ^ tables[3][x >> 24]


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """Four byte tables of the map that appends ``2**power`` zero bytes."""
    if power == 0:
        t0, basis = _byte_table(), np.uint32(1) << np.arange(32, dtype=np.uint32)
        images = t0[basis & 0xFF] ^ (basis >> 8)
    else:
        half = _zeros(power - 1)
        images = _apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    tables = np.zeros((4, 256), np.uint32)
    byte = np.arange(256)
    for bit in range(32):
        tables[bit // 8] ^= np.where(byte >> (bit % 8) & 1, images[bit], 0).astype(np.uint32)
    return tables


def _append_zeros(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = x.copy()
    for power in range(int(counts.max(initial=0)).bit_length()):
        hit = (counts >> power & 1).astype(bool)
        x[hit] = _apply(_zeros(power), x[hit])
    return x


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums (uint32) of ``data[starts[i] : starts[i] + lengths[i]]``; an empty range has 0."""
    data, starts, lengths = np.asarray(data, np.uint8), np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    size = BLOCK if lengths.max() > 8 else 8
    blocks = np.maximum(1, -(-lengths // size))
    padded, ends = np.zeros(int(blocks.sum()) * size, np.uint8), np.cumsum(blocks) * size
    for start, length, end in zip(starts.tolist(), lengths.tolist(), ends.tolist()):
        padded[end - length : end] = data[start : start + length]
    words = np.ascontiguousarray(padded.view("<u4").reshape(-1, size // 4).T)
    register, (low, high) = np.zeros(words.shape[1], np.uint32), _word_tables()
    for word in words:
        register ^= word
        register = low[register & np.uint32(0xFFFF)] ^ high[register >> np.uint32(16)]
    owner = np.repeat(np.arange(len(starts)), blocks)
    behind = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))  # whole blocks that follow in the range
    out = _append_zeros(np.full(len(starts), 0xFFFFFFFF, np.uint32), lengths)
    np.bitwise_xor.at(out, owner, _append_zeros(register, behind * size))
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and offset, so that a checksum of bytes that hold checksums stays meaningful."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
