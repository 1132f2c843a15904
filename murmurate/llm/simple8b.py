"""Simple-8b: as many small integers as fit into 64-bit words, in blocks that decode side by side.

The top 4 bits of a word select how many values it holds and in how many bits each. Values of
60 bits and more are escapes: the word holds their place in a list behind the words. Blocks
hold BLOCK values (the last may hold fewer) and begin at offsets that the segment lists.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
#: Values a word, and bits a value, by selector; selector 1 is an escape.
COUNT = np.array([60, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_MAGIC, _HEAD = b"S8B1", struct.Struct("<4sIQIII")


def bit_lengths(v: np.ndarray) -> np.ndarray:
    high = (v >> np.uint64(32)).astype(np.float64)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the offset of each block (and the end), and escaped values."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = v
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    bits = bit_lengths(grid.reshape(-1)).reshape(grid.shape)
    runs = {1: bits}
    for w in (2, 4, 8, 16, 32):
        runs[w] = runs[w // 2].copy()
        np.maximum(runs[w][:, : -(w // 2)], runs[w // 2][:, w // 2 :], out=runs[w][:, : -(w // 2)])
    chosen = np.full((blocks, BLOCK), 255, np.uint8)
    for s in range(16):  # the first that fits holds the most values
        if s == 1:
            continue
        c, b = int(COUNT[s]), int(BITS[s])
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(runs[p][:, :BLOCK], runs[p][:, c - p : c - p + BLOCK])
        chosen[(chosen == 255) & (most <= b)] = s
    chosen[chosen == 255] = 1
    held = np.minimum(np.full(blocks, BLOCK), n - np.arange(blocks) * BLOCK)
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    took_block, took_at = [], []
    while len(live):
        took_block.append(live)
        took_at.append(at[live])
        at[live] += COUNT[chosen[live, at[live]]]
        live = live[at[live] < held[live]]
    block, where = np.concatenate(took_block), np.concatenate(took_at)
    order = np.lexsort((where, block))
    block, where = block[order], where[order]
    sel = chosen[block, where]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if s == 1:
            continue
        own = np.flatnonzero(sel == s)
        for j in range(int(COUNT[s]) if BITS[s] else 0):
            words[own] |= grid[block[own], where[own] + j] << np.uint64(j * BITS[s])
    odd = np.flatnonzero(sel == 1)
    words[odd] |= np.arange(len(odd), dtype=np.uint64)
    offsets = np.searchsorted(block, np.arange(blocks + 1)).astype(np.uint32)
    return words, offsets, grid[block[odd], where[odd]]


def decode(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    blocks = len(offsets) - 1
    block = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    sums = np.zeros(len(sel) + 1, np.int64)
    np.cumsum(COUNT[sel], out=sums[1:])
    inside = sums[:-1] - sums[offsets[:-1].astype(np.int64)][block] if blocks else sums[:-1]
    out = np.zeros(blocks * BLOCK, np.uint64)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        if s == 1:
            out[block[own] * BLOCK + inside[own]] = escaped[body[own].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNT[s]) if BITS[s] else 0):
            ok = inside[own] + j < BLOCK
            out[block[own][ok] * BLOCK + inside[own][ok] + j] = (body[own][ok] >> np.uint64(j * BITS[s])) & mask
    return out[:n]


def pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment: header, lengths of its documents, block offsets, words, escapes."""
    words, offsets, escaped = encode(values)
    head = _HEAD.pack(_MAGIC, len(lengths), len(values), len(offsets), len(words), len(escaped))
    return b"".join([head, lengths.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()])


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values of a segment and the lengths of its documents."""
    magic, docs, n, n_offs, n_words, n_esc = _HEAD.unpack_from(segment)
    if magic != _MAGIC:
        raise ValueError("not a Simple-8b segment")
    parts, at = [], _HEAD.size
    for kind, count in (("<u8", docs), ("<u4", n_offs), ("<u8", n_words), ("<u8", n_esc)):
        parts.append(np.frombuffer(segment, kind, count, at))
        at += np.dtype(kind).itemsize * count
    lengths, offsets, words, escaped = parts
    return decode(words, offsets, escaped, n), lengths.astype(np.int64)
