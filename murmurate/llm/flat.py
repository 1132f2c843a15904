"""Vectorised views of an Arrow text column: bytes, words and 64-bit names of words.

Texts are handled as UTF-8 bytes inside numpy arrays, a few MB at a time, so that memory
is bounded by the chunk (or by one text, where that is longer) and not by the batch.
A word is a run of bytes other than 0x20 and 0x09-0x0D; null texts are empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once.
CHUNK = 400_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with capitals as small letters.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
_ODD = np.uint64(1)
_rng = np.random.default_rng(20240229)
#: The modulus of sequence hashes: a prime, so that no pattern of symbols (as powers of two have them) makes hashes meet.
PRIME = 2**61 - 1
_P, _LOW32, _LOW29, _LOW31 = (np.uint64(x) for x in (PRIME, 2**32 - 1, 2**29 - 1, 2**31 - 1))
_BASES = [int(x) for x in _rng.integers(2**40, PRIME, 2)]
_POWERS: dict[int, np.ndarray] = {}
_MASKS = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Byte ranges beyond this many bytes are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo PRIME, of values below it."""
    b = np.uint64(b) if np.isscalar(b) else b
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    mid, low = ah * bl + al * bh, al * bl
    return _reduced(ah * bh * np.uint64(8) + (mid >> np.uint64(29)) + ((mid & _LOW29) << np.uint64(32)) + (low >> np.uint64(61)) + (low & _P))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, mulmod(have, pow(base, len(have), PRIME))])
        _POWERS[base] = have
    return have


class Prefix:
    """Hashes of any ranges of a sequence of 64-bit values: a polynomial modulo PRIME."""

    def __init__(self, values: np.ndarray, second: bool = False):
        base = _BASES[second]
        n = len(values)
        terms = mulmod(_reduced(values), _powers(base, n + 1)[:n])
        self.down = _powers(pow(base, -1, PRIME), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _reduced(mulmod(np.cumsum(terms >> np.uint64(31), dtype=np.uint64), 2**31) + _reduced(np.cumsum(terms & _LOW31, dtype=np.uint64)))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mulmod(_reduced(self.sums[end] + (_P - self.sums[start])), self.down[start])
        return mix(h + (end - start).astype(np.uint64) * _K1)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of byte ranges, 8 bytes at a time in two lanes; long ranges by BLAKE2."""
    n = (end - start).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    one = mix(n.astype(np.uint64) * _K1 + _K2)
    two = mix(n.astype(np.uint64) * _K2 + _K1)
    own = np.flatnonzero((n > 0) & (n <= _LONG))
    for k in range(0, _LONG, 8):
        if not len(own):
            break
        block = eight[start[own] + k] & _MASKS[np.minimum(n[own] - k, 8)]
        one[own] = mix(one[own] ^ block * _K2)
        two[own] = mix(two[own] + mix(block + _K1))
        own = own[n[own] > k + 8]
    out = mix(one + mix(two ^ _K1))
    long_ = np.flatnonzero(n > _LONG)
    if len(long_):
        raw = memoryview(np.ascontiguousarray(data))
        out[long_] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(start[long_].tolist(), end[long_].tolist())]
    return out


def trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    trimmer = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trimmer:
        trimmer(0)


def tidy(run):
    """run, after which the worker (Spark uses it again) hands back the memory that its last part has left."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (with the end of the last)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offs = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about size bytes; a longer text stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """Words of consecutive texts: start and end bytes; first[i] is the first word of text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        inside = ~SPACE[data]
        n = len(data)
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edges] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def names(self, lower: bool = False) -> np.ndarray:
        """64-bit names of the words: equal words have equal names, and others meet by chance only."""
        return hashes(SMALL[self.data] if lower else self.data, self.start, self.end)


_COEFS = mix(np.arange(1, 257, dtype=np.uint64)) | _ODD


def grams(names: np.ndarray, n: int) -> np.ndarray:
    """Names of the n words from each word on (across texts too: callers mask those)."""
    m = max(0, len(names) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += names[j : j + m] * _COEFS[j]
    return mix(out)


def gram_mask(first: np.ndarray, n: int) -> np.ndarray:
    """Which words begin n words of their own text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for j in range(1, n):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows: each element's row, and its place within the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    return row, np.arange(len(row)) - begin[row]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a string array."""
    lengths = (end - start).astype(np.int64)
    row, place = spread(lengths)
    out = data[start[row] + place] if len(row) else data[:0]
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(out.tobytes()))
