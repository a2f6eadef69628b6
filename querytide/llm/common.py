"""Helpers shared by the operators: Arrow batches cut to a byte size, word hashes, output columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The white space of the contracts: [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"
# Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 1 << 19


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def filled(column: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty), with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def passes(batches: Iterable[pa.RecordBatch], text: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(ends[end - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array in a row, and the offset of each text (one more than texts)."""
    column = filled(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
# Two primes below 2^31 with a base each. A product fits 64 bits, and so does the sum of 2^32 remainders.
_FIELDS = ((0x7FFFFFFF, 0x2545F491), (0x7FFFFFED, 0x5851F42D))
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_IS_SPACE = np.isin(np.arange(256), list(SPACE_BYTES))
_ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first powers of a base modulo a prime, ``n`` at least; kept in the process."""
    known = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)])
    _POWERS[base, prime] = known
    return known


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand.

    Polynomials modulo two primes and the length: modulo a power of two, words of one pattern and its
    complement would collide whatever the base.
    """
    values = _BYTE_VALUES[raw]
    parts = []
    for prime, base in _FIELDS:
        p = np.uint64(prime)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values * _powers(base, prime, len(raw))[: len(raw)] % p, out=sums[1:])
        back = _powers(pow(base, -1, prime), prime, len(raw) + 1)
        parts.append((sums[ends] - sums[starts]) % p * back[starts] % p)
    return mixed(mixed(parts[0] << np.uint64(31) | parts[1]) + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, split at white space) of all texts, and where each text's words begin."""
    raw = _ASCII_LOWER[raw]
    inside = ~_IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1 : len(raw)]
    ends[:-1] &= ~inside[1:] | first[1 : len(raw)]
    starts = np.flatnonzero(begins)
    return span_hashes(raw, starts, np.flatnonzero(ends) + 1), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, positions: bool = False):
    """Per text the sorted hashes of its distinct ``width``-word shingles; fewer words are one shingle, no words none.

    With ``positions`` also where in its text each of them begins first, in words.
    """
    words, bounds = word_hashes(raw, offsets)
    weights = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width if len(whole) else 0):
        whole += words[i : i + len(whole)] * weights[i]
    whole = mixed(whole)
    out, at = [], []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= width:
            if positions:
                own, first = np.unique(whole[begin : end - width + 1], return_index=True)
                out.append(own)
                at.append(first)
            else:
                out.append(np.unique(whole[begin : end - width + 1]))
            continue
        at.append(np.zeros(int(end > begin), np.int64))
        if end > begin:
            short = (words[begin:end] * weights[: end - begin]).sum(dtype=np.uint64) + np.uint64(end - begin)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return (out, at) if positions else out
