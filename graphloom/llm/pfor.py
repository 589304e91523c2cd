"""Token-id files of patched frame-of-reference blocks.

Layout (little-endian): magic "PFR1"; blocks; exception lists; document table; index;
footer. A block holds up to 128 ids: its minimum is subtracted, the low `width` bits of
each difference are packed (width: the bits that the chosen percentile of the differences
needs), and the rest of larger ones goes to the exception list as (place, high bits).
The index has the byte at which each block starts, its minimum, width, and first
exception, so any id can be read without what stands before it.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BLOCK = 128
MAGIC = b"PFR1"
_FOOT = struct.Struct("<8QI4s")


@dataclass
class TokenFile:
    """What read() gives: ids of all documents on end, where each document ends, and its id (valid: not null)."""

    ids: np.ndarray
    ends: np.ndarray
    doc_ids: np.ndarray
    valid: np.ndarray


def _widths(diff: np.ndarray, counts: np.ndarray, percentile: float) -> np.ndarray:
    """Bits that the value at the percentile of each block needs (padding, which is at the end, does not count)."""
    high = diff.astype(np.uint32)
    if counts[-1] < BLOCK:
        high[-1, counts[-1] :] = np.iinfo(np.uint32).max
    rank = np.minimum(np.maximum(np.ceil(counts * percentile).astype(np.int64) - 1, 0), counts - 1)
    high.sort(axis=1)
    chosen = high[np.arange(len(diff)), rank].astype(np.int64)
    return np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1))).astype(np.int64) + 1, 0)


def encode(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, percentile: float = 0.9) -> bytes:
    """A file's bytes. ids: unsigned 32-bit values of all documents on end."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    counts = np.full(blocks, BLOCK, dtype=np.int64)
    if n % BLOCK:
        counts[-1] = n % BLOCK
    full = np.zeros(blocks * BLOCK, dtype=np.int64)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = full[n - 1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.empty(0, np.int64)
    diff = full - low[:, None]
    width = _widths(diff, counts, percentile) if blocks else np.empty(0, np.int64)
    size = BLOCK * width // 8
    starts = np.zeros(blocks, dtype=np.int64)
    if blocks:
        starts[1:] = np.cumsum(size)[:-1]
    body = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        for k in range(0, len(at), 2048):
            some = at[k : k + 2048]
            kind = "<u2" if w <= 16 else "<u4"
            bits = np.unpackbits(diff[some].astype(kind).view(np.uint8).reshape(len(some), BLOCK, -1), axis=2, bitorder="little")
            packed = np.packbits(bits[:, :, :w].reshape(len(some), -1), axis=1, bitorder="little")
            body[starts[some][:, None] + np.arange(packed.shape[1])] = packed
    over = diff >> width[:, None]
    row, place = np.nonzero(over)
    high = over[row, place].astype("<u4")
    first = np.searchsorted(row, np.arange(blocks + 1)).astype("<u8")
    parts = [
        body.tobytes(),
        place.astype(np.uint8).tobytes() + high.tobytes(),
        doc_ids.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + np.cumsum(lengths).astype("<u8").tobytes(),
        starts.astype("<u8").tobytes() + low.astype("<u4").tobytes() + width.astype(np.uint8).tobytes() + first.tobytes(),
    ]
    offs = np.cumsum([len(MAGIC), *map(len, parts)])[:-1]
    whole = MAGIC + b"".join(parts)
    return whole + _FOOT.pack(n, blocks, len(high), len(lengths), *offs, zlib.crc32(whole), MAGIC)


def _parts(data: bytes) -> tuple:
    n, blocks, over, docs, o_body, o_over, o_docs, o_index, crc, magic = _FOOT.unpack(data[-_FOOT.size :])
    if magic != MAGIC or zlib.crc32(memoryview(data)[: -_FOOT.size]) != crc:
        raise ValueError("not a whole token file")
    take = lambda kind, count, at: (np.frombuffer(data, kind, count, at), at + np.dtype(kind).itemsize * count)
    starts, at = take("<u8", blocks, o_index)
    low, at = take("<u4", blocks, at)
    width, at = take("u1", blocks, at)
    first, _ = take("<u8", blocks + 1, at)
    place, at = take("u1", over, o_over)
    high, _ = take("<u4", over, at)
    doc_ids, at = take("<i8", docs, o_docs)
    valid, at = take("u1", docs, at)
    ends, _ = take("<u8", docs, at)
    return n, o_body, starts, low, width, first, place, high, doc_ids, valid, ends


def _unpack(data: bytes, parts: tuple, some: np.ndarray) -> np.ndarray:
    """The ids of the blocks `some` (numbers, ascending), padding included."""
    _, o_body, starts, low, width, first, place, high, *_ = parts
    out = np.zeros((len(some), BLOCK), dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width[some]):
        at = np.flatnonzero(width[some] == w)
        if not w:
            continue
        for k in range(0, len(at), 2048):
            mine = at[k : k + 2048]
            packed = raw[o_body + starts[some[mine]].astype(np.int64)[:, None] + np.arange(BLOCK * int(w) // 8)]
            # each value lies in at most five bytes from the one that holds its first bit
            at_bit = np.arange(BLOCK) * int(w)
            byte, shift = at_bit >> 3, (at_bit & 7).astype(np.uint64)
            packed = np.pad(packed, ((0, 0), (0, 5)))
            kind = np.uint32 if w <= 24 else np.uint64
            value = packed[:, byte].astype(kind)
            for n in range(1, (int(w) + 14) // 8):
                value |= packed[:, byte + n].astype(kind) << kind(8 * n)
            out[mine] = (value >> shift.astype(kind)) & kind((1 << int(w)) - 1)
    a, b = first[some].astype(np.int64), first[some + 1].astype(np.int64)
    row = np.repeat(np.arange(len(some)), b - a)
    which = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)]) if len(row) else np.empty(0, np.int64)
    out[row, place[which]] += high[which].astype(np.int64) << width[some[row]].astype(np.int64)
    return out + low[some].astype(np.int64)[:, None]


def read(data: bytes) -> TokenFile:
    parts = _parts(data)
    n, blocks = parts[0], len(parts[2])
    ids = _unpack(data, parts, np.arange(blocks)).reshape(-1)[:n].astype(np.uint32)
    return TokenFile(ids, parts[-1].astype(np.int64), parts[-3], parts[-2].astype(bool))


def read_span(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop, from the blocks that hold them alone."""
    parts = _parts(data)
    start, stop = max(0, start), min(stop, parts[0])
    if start >= stop:
        return np.empty(0, np.uint32)
    some = np.arange(start // BLOCK, (stop - 1) // BLOCK + 1)
    ids = _unpack(data, parts, some).reshape(-1)
    return ids[start - some[0] * BLOCK : stop - some[0] * BLOCK].astype(np.uint32)
