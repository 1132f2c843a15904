"""Tokens of whole texts, counted by finite-state transducers compiled from a byte-level BPE vocabulary.

The outer transducer cuts text into the pre-tokenizer's pieces. It has 8 states; its input are classes of
characters. Text is run in chunks of 64 characters side by side: each chunk yields a map from the state
before it to the state after it, maps compose by a parallel prefix scan, and with the states before all chunks
known each chunk emits where pieces begin.

The inner transducer reads the bytes of a piece. After each byte, the encoding of what was read ends in exactly
one token: the one that ends there and may stand after the encoding of what comes before it. A state is thus
what later tokens can reach back to: the longest suffix that begins some token, with the last token and the
count before each of its bytes. States and transitions are compiled when first met; a transition bears
the change in the number of tokens. A table of known pieces, of fixed size, saves running the common ones.

Null texts are empty: 0 tokens. Repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, tokens

# Classes of characters, where the next two are looked at too.
LETTER, DIGIT, OTHER, QUOTE1, QUOTE2, GAP, BREAK, SPACES = range(8)
# States: what the piece so far is. FREE: the next character begins a piece whatever it is.
FREE, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_GAP, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)
_STEP = 64
_SLOT_BITS = 20


def _compile_outer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by state and class; classes from 8 on begin a text."""
    go, new = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    joins = {LETTER: (IN_LETTERS, {IN_LETTERS, AFTER_GAP}), DIGIT: (IN_DIGITS, {IN_DIGITS, AFTER_GAP}), OTHER: (IN_OTHER, {IN_OTHER, AFTER_GAP}), GAP: (AFTER_GAP, set()), BREAK: (FREE, set()), SPACES: (IN_SPACES, {IN_SPACES})}
    for state in range(8):
        for c in range(8):
            if state in (ONE_LEFT, TWO_LEFT):
                go[state, c] = FREE if state == ONE_LEFT else ONE_LEFT
            elif c in (QUOTE1, QUOTE2):
                run = state in (IN_OTHER, AFTER_GAP)
                go[state, c], new[state, c] = (IN_OTHER if run else ONE_LEFT if c == QUOTE1 else TWO_LEFT), not run
            else:
                go[state, c], new[state, c] = joins[c][0], state not in joins[c][1]
    go[:, 8:], new[:, 8:] = go[FREE, :8], True
    return go, new


_GO, _NEW = _compile_outer()
_KINDS = np.full(0x110000, 255, np.uint8)
_WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_KINDS[[9, 10, 11, 12, 13, 32, *_WIDE]] = SPACES


def _classes(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Classes of characters; begins: which ones begin a text."""
    kind = _KINDS[points]
    if (kind == 255).any():
        for p in np.unique(points[kind == 255]).tolist():
            c = unicodedata.category(chr(p))[0]
            _KINDS[p] = LETTER if c == "L" else DIGIT if c == "N" else OTHER
        kind = _KINDS[points]
    last = np.append(begins[1:], True)  # of its text
    space = kind == SPACES
    before_word = space & ~np.append(space[1:], False) & ~last
    out = kind.copy()
    out[before_word] = BREAK
    out[before_word & (points == 32)] = GAP
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        end = len(points) - 1
        one, two = np.minimum(quotes + 1, end), np.minimum(quotes + 2, end)
        has1 = ~last[quotes]
        has2 = has1 & ~last[one]
        a, b = points[one], points[two]
        out[quotes[has1 & np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE1
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quotes[has2 & pair]] = QUOTE2
    out[begins] += 8
    return out


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Which characters begin a piece."""
    n = len(classes)
    rows = -(-n // _STEP)
    grid = np.zeros(rows * _STEP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, _STEP).T)
    flat_go = _GO.reshape(-1)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = flat_go[maps * np.uint8(16) + column[:, None]]
    gap = 1
    while gap < rows:  # maps[i] becomes the map of all chunks up to i
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        gap *= 2
    state = np.full(rows, FREE, np.uint8)
    state[1:] = maps[:-1, FREE]
    out = np.empty((_STEP, rows), bool)
    flat_new = _NEW.reshape(-1)
    for j, column in enumerate(grid):
        at = state * np.uint8(16) + column
        out[j] = flat_new[at]
        state = flat_go[at]
    return out.T.reshape(-1)[:n]


class Automaton:
    """The inner transducer, of a tokenizers file with a byte-level BPE model."""

    #: States held before compiling anew.
    MOST = 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

        def raw(token: str) -> bytes:
            return bytes(spelled[c] for c in token)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in spelled for c in t)}
        self.begins = {t[:k] for t in tokens for k in range(1, len(t) + 1)}
        self.tokens, self.fits, self.whole = tokens, {}, {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.what: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self._state((b"", (b"",), (0,)))

    def _state(self, key: tuple) -> int:
        at = self.states.setdefault(key, len(self.what))
        if at == len(self.what):
            self.what.append(key)
        return at

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        while True:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks, default=1 << 60)
            if best == 1 << 60:
                return parts
            i = ranks.index(best)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    def _fit(self, before: bytes, token: bytes) -> bool:
        """Whether the encoding of before + token is just these two."""
        key = (before, token)
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            text = before + token
            got = self.fits[key] = self._merged([text[i : i + 1] for i in range(len(text))]) == ([before, token] if before else [token])
        return got

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, count = self.what[state]
        text = suffix + bytes([byte])
        keep = next(k for k in range(len(text) + 1) if text[k:] in self.begins or k == len(text))
        for k in range(len(text)):  # longest first; one token alone can stand there
            if text[k:] in self.tokens and self._fit(last[k], text[k:]) and self._fit(b"", text[k:]):
                token, now = text[k:], count[k] + 1
                break
        else:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        # counts are kept against the one after this byte
        return self._state((text[keep:], (*last, token)[keep:], tuple(c - now for c in (*count, now)[keep:]))), now

    def count(self, piece: bytes) -> int:
        state, total, moves = self.start, 0, self.moves
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._compile(state, byte)
            state = move[0]
            total += move[1]
        if len(self.what) > self.MOST:
            self._clear()
        return total


class Counter:
    """Token counts of texts, with the pieces it knows."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.known = np.zeros(1 << _SLOT_BITS, np.int64)

    def _specials(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Start and end of special strings within texts: each is one token, and cuts the text."""
        raw, found = data.tobytes(), []
        for special in self.automaton.special:
            at = raw.find(special)
            while at >= 0:
                if np.searchsorted(offs, at, "right") == np.searchsorted(offs, at + len(special) - 1, "right"):
                    found.append((at, at + len(special)))
                at = raw.find(special, at + len(special))
        return np.array(sorted(found), np.int64).reshape(-1, 2)

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        special = self._specials(data, offs)
        cuts = np.unique(np.concatenate([offs[:-1][offs[:-1] < len(data)], special.reshape(-1)[special.reshape(-1) < len(data)]]))
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        where = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character begins
        begins = np.zeros(len(points), bool)
        begins[np.searchsorted(where, cuts)] = True
        start = where[piece_starts(_classes(points, begins))]
        end = np.append(start[1:], len(data))
        names = flat.hashes(data, start, end)
        slot = (names >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        counts = self.known[slot]
        miss = np.flatnonzero(self.keys[slot] != names)
        if len(miss):
            new, one, back = np.unique(names[miss], return_index=True, return_inverse=True)
            one = miss[one]
            raw = data.tobytes()
            got = np.array([self.automaton.count(raw[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist())], np.int64)
            counts[miss] = got[back]
            self.keys[slot[one]], self.known[slot[one]] = new, got
        if len(special):
            counts[np.isin(start, special[:, 0])] = 1
            inside = np.searchsorted(special[:, 0], start, "right") - 1
            within = (inside >= 0) & (start < special[inside, 1]) & (start != special[inside, 0])
            counts[within] = 0
        sums = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        return np.diff(sums[np.searchsorted(start, offs)])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(tokens.vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than limit) of each row."""

    def count(batches):
        own = counter(tokenizer)
        for batch in batches:
            data, offs = flat.flatten(batch.column(1))
            n = [own.count(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in flat.chunks(offs)]
            n = np.concatenate([np.zeros(0, np.int64), *n])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(flat.tidy(count), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
