"""Token ids of whole texts, by the tokenizers library, once for each distinct piece of text.

Byte-pair encoders never join characters across the borders that their pre-tokenizer draws.
Texts are therefore cut where such a border always lies, the library encodes each distinct
piece, and numpy lays the ids of the pieces in a row. Pieces are known by a 64-bit name;
the table of known pieces has a fixed size, and what falls out of it is encoded again.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from . import flat

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SLOT_BITS = 21
#: Ids held for known pieces before the table is emptied.
_HELD = 6_000_000


def vocabulary(name: str) -> str:
    """The place of a vocabulary file, on the machine that asks: tasks ask for themselves. A path stands for itself."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _wide_space(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII ends just before each place."""
    a, b, c = (data[np.maximum(end - k, 0)] for k in (1, 2, 3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    e2 = (c == 0xE2) & (((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) & (a >= 0x80)) | ((b == 0x81) & (a == 0x9F)))
    return two | e2 | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


def spaced_pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of pieces that begin with the white space before a word, and the first piece of each text."""
    space = flat.SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[offs[:-1][offs[:-1] < len(data)]] = True
    at = np.flatnonzero(cut)
    odd = np.flatnonzero((at > 0) & (data[np.maximum(at - 1, 0)] >= 0x80))
    odd = odd[_wide_space(data, at[odd])]
    if len(odd):
        odd = odd[~np.isin(at[odd], offs)]
        at = np.delete(at, odd)
    return at, np.append(at[1:], len(data)), np.searchsorted(at, offs)


class Coder:
    """Ids of pieces. words: pieces are words (of a tokenizer that drops white space), else words with the space before them."""

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Bytes that an id spells, one for each character of a byte-level token.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token.removesuffix("</w>") if words else token)
        self.clear()

    def clear(self) -> None:
        """Forgets the known pieces."""
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, np.int64)
        self.size = np.zeros(1 << _SLOT_BITS, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _put(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _add(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = self._put(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
        return at + np.cumsum(sizes) - sizes, sizes

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece are, and how many.

        Most pieces are encoded in rows of thousands: borders lie between them, and the bytes that ids
        spell tell whose they are. That needs pieces with white space before a word; or, of a tokenizer
        that normalises words, words of ASCII and Latin-1, whose small letters have as many bytes.
        """
        if self.words:
            lead = np.append(0, np.cumsum((data >= 0xC0) & (data != 0xC3)))
            joined = lead[end] == lead[start]
        else:
            joined = flat.SPACE[data[start]] & ~flat.SPACE[data[end - 1]] & ~_wide_space(data, end)
        at, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        alone = np.flatnonzero(~joined)
        at[alone], size[alone] = self._add(self._ask(flat.strings(data, start[alone], end[alone]).to_pylist()))
        for own in np.array_split(np.flatnonzero(joined), max(1, int(joined.sum()) // 4000)):
            length = end[own] - start[own]
            row, place = flat.spread(length + self.words)
            text = np.full(len(row), 32, np.uint8)
            text[place < length[row]] = data[(start[own][row] + place)[place < length[row]]]
            ids = np.array(self._ask([text.tobytes().decode()])[0], np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(length)) + 1
            size[own] = np.diff(ends, prepend=0)
            at[own] = self._put(ids) + ends - size[own]
        return at, size

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with end_id after it, and where each text's ids begin."""
        if self.words:
            w = flat.Words(data, offs)
            start, end, first, names = w.start, w.end, w.first, w.names()
        else:
            start, end, first = spaced_pieces(data, offs)
            names = flat.hashes(data, start, end)
        if self.used > _HELD:
            self.clear()
        slot = (names >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(self.keys[slot] != names)
        if len(miss):
            new, one, back = np.unique(names[miss], return_index=True, return_inverse=True)
            one = miss[one]
            new_at, new_size = self._ask_all(data, start[one], end[one])
            at[miss], size[miss] = new_at[back], new_size[back]
            self.keys[slot[one]], self.at[slot[one]], self.size[slot[one]] = new, new_at, new_size
        sums = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        n = len(offs) - 1
        where = sums[first] + np.arange(n + 1)
        out = np.empty(int(where[-1]), np.uint32)
        row = np.repeat(np.arange(len(size)), size)
        got = self.ids[(at - sums[:-1])[row] + np.arange(len(row))]
        keep = np.ones(len(out), bool)
        keep[where[1:] - 1] = False
        out[keep] = got
        out[where[1:] - 1] = end_id
        return out, where


_coders: dict[tuple[str, bool], Coder] = {}


def coder(path: str, words: bool) -> Coder:
    """One for each worker process."""
    if (path, words) not in _coders:
        _coders[path, words] = Coder(vocabulary(path), words)
    return _coders[path, words]
