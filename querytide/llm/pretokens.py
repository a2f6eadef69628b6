"""Pre-tokens of a byte-level BPE found by numpy, and a growing table from piece hash to token ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from querytide.llm.common import span_hashes

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# The code points that \s matches, and the contractions of the pattern.
_SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point; made once in a process."""
    if not _CLASSES:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.full(0x110000, _OTHER, np.uint8)
        # From U+40000 on there are only unassigned, tag and private code points.
        table[:0x40000] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x40000)), np.uint8, 0x40000)
        table[_SPACES] = _SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def pretoken_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of all texts begin, in order.

    The same cuts as the alternatives ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
    runs of one class; of a run of spaces before something else the last one stands alone, or
    joins what follows if it is U+0020; a contraction ends after its letters.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)
    at = np.concatenate([[0], ends[:-1]])  # byte offset of each code point
    kind = _classes()[points]
    text_start = np.zeros(len(points) + 1, bool)
    text_start[np.searchsorted(at, offsets[:-1])] = True
    text_start[len(points)] = True  # empty texts at the end point here as well
    start = text_start[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = space & ~text_start[1:]
    last[:-1] &= ~space[1:]
    last[-1] = False  # the last space of a run that something follows in its text
    start |= last
    joined = last & (points == 0x20)
    start[1:] &= ~joined[:-1]
    start[np.flatnonzero(text_start[:-1])] = True
    quotes = np.flatnonzero((points == 0x27) & start)
    for q in quotes.tolist():
        for letters in _CONTRACTIONS:
            end = q + 1 + len(letters)
            if end <= len(points) and not text_start[q + 1 : end].any() and points[q + 1 : end].tolist() == [ord(c) for c in letters]:
                start[q + 1 : end] = False
                if end < len(points):
                    start[end] = True
                break
    return at[start]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """A longer copy whose new part takes no memory before it is written to."""
    out = np.empty(n, a.dtype)
    out[: len(a)] = a
    return out


class PieceTable:
    """Open addressing from piece hash to a run of ids, in numpy arrays, for ``most`` pieces."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.bits = most.bit_length()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        self.begins = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int32)
        self.ids = np.zeros(8192, np.uint16)
        self.used = 0
        self.piece_begins = np.zeros(1024, np.int64)
        self.piece_sizes = np.zeros(1024, np.int64)
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.held = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if it isn't known."""
        mask = np.uint64((1 << self.bits) - 1)
        at = hashes & mask
        found = self.slots[at]
        todo = np.flatnonzero((found >= 0) & (self.keys[at] != hashes))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & mask
            found[todo] = self.slots[at[todo]]
            todo = todo[(found[todo] >= 0) & (self.keys[at[todo]] != hashes[todo])]
        return found

    def differing(self, entries: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which pieces aren't those of their entries although their hashes are equal."""
        return np.flatnonzero(_unequal(raw, starts, ends - starts, self.bytes, self.piece_begins[entries], self.piece_sizes[entries]))

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, pieces: list[bytes]) -> None:
        """New distinct hashes and their pieces, whose ids stand one after the other in ``ids``."""
        n, used = self.n + len(hashes), self.used + len(ids)
        if n > len(self.begins):
            self.begins, self.sizes = _grown(self.begins, 2 * n), _grown(self.sizes, 2 * n)
            self.piece_begins, self.piece_sizes = _grown(self.piece_begins, 2 * n), _grown(self.piece_sizes, 2 * n)
        lengths = np.array([len(p) for p in pieces], np.int64)
        held = self.held + int(lengths.sum())
        if held > len(self.bytes):
            self.bytes = _grown(self.bytes, 2 * held)
        self.bytes[self.held : held] = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes[self.n : n] = lengths
        self.piece_begins[self.n : n] = self.held + np.cumsum(lengths) - lengths
        self.held = held
        if used > len(self.ids):
            self.ids = _grown(self.ids, 2 * used)
        self.sizes[self.n : n] = sizes
        self.begins[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = ids
        mask = np.uint64((1 << self.bits) - 1)
        todo, at = np.arange(len(hashes)), hashes & mask
        while len(todo):
            free = self.slots[at[todo]] < 0
            self.slots[at[todo[free]]] = self.n + todo[free]  # the last of those that want one slot gets it
            won = self.slots[at[todo]] == self.n + todo
            self.keys[at[todo[won]]] = hashes[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + np.uint64(1)) & mask
        self.n, self.used = n, used


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices begin, begin + 1, ... of all runs in a row."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(begins - (ends - sizes), sizes)


def _unequal(a: np.ndarray, a_begins: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_begins: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Per pair of byte spans whether they differ."""
    out = a_sizes != b_sizes
    same = np.flatnonzero(~out & (a_sizes > 0))
    sizes = a_sizes[same]
    if len(same):
        wrong = a[ragged(a_begins[same], sizes)] != b[ragged(b_begins[same], sizes)]
        out[same] = np.logical_or.reduceat(wrong, np.cumsum(sizes) - sizes)
    return out


def encode_texts(
    raw: np.ndarray, offsets: np.ndarray, table: PieceTable, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the offset of each text's ids.

    ``encode`` gives the ids (all in a row, and how many each piece has) of pieces that ``table`` doesn't know.
    """
    starts = pretoken_starts(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    ends = np.concatenate([starts[1:], [len(raw)]])
    hashes = span_hashes(raw, starts, ends)
    entries = table.find(hashes)
    unknown = np.flatnonzero(entries < 0)
    if len(unknown):
        new, first = np.unique(hashes[unknown], return_index=True)
        first = unknown[first]
        data = raw.tobytes()
        if table.n + len(new) > table.most:
            table.forget()
            if len(np.unique(hashes)) > table.most // 2:
                return _large(hashes, starts, ends, raw, offsets, encode)
            return encode_texts(raw, offsets, table, encode)  # an empty table holds all of them
        pieces = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        table.add(new, *encode(pieces), pieces)
        entries[unknown] = table.find(hashes[unknown])
    begins, sizes, ids = table.begins[entries], table.sizes[entries], table.ids
    begins, sizes, ids = _mended(table.differing(entries, raw, starts, ends), begins, sizes, ids, raw, starts, ends, encode)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return ids[ragged(begins, sizes)], before[np.searchsorted(starts, offsets)]


def _mended(wrong, begins, sizes, ids, raw, starts, ends, encode):
    """Pieces that share a hash with another one get ids of their own."""
    if len(wrong):
        own, counts = encode([raw[s:e].tobytes() for s, e in zip(starts[wrong].tolist(), ends[wrong].tolist())])
        begins, sizes = begins.copy(), sizes.copy()
        begins[wrong], sizes[wrong] = len(ids) + np.cumsum(counts) - counts, counts
        ids = np.concatenate([ids, own])
    return begins, sizes, ids


def _large(hashes, starts, ends, raw, offsets, encode):
    """More distinct pieces at once than the table should hold: they are encoded without it."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    data = raw.tobytes()
    ids, own = encode([data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
    begins = np.cumsum(own) - own
    like = first[inverse]
    wrong = np.flatnonzero(_unequal(raw, starts, ends - starts, raw, starts[like], (ends - starts)[like]))
    begins, sizes, ids = _mended(wrong, begins[inverse], own[inverse], ids, raw, starts, ends, encode)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return ids[ragged(begins, sizes)], before[np.searchsorted(starts, offsets)]
