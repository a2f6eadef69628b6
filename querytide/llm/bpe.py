"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the others through a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.llm.common import mixed, passes, span_hashes, text_bytes
from querytide.llm.pretokens import PieceTable, encode_texts, ragged

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TRIES = 64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (Base64 token, rank), by rank. Read on the driver: a vocabulary is small."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash by displacement: ``n`` keys in ``n`` slots, with one small number for each bucket of about four."""

    def __init__(self, hashes: np.ndarray):
        self.n = n = len(hashes)
        self.buckets = max(1, n // 4)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys = np.zeros(n, np.uint64)
        self.values = np.zeros(n, np.int32)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        open_slots: list[int] = []
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) == 1:  # takes any slot that is left; stored as a negative number
                open_slots = open_slots or np.flatnonzero(free).tolist()
                slots = np.array([open_slots.pop()])
                self.shift[b] = -1 - slots[0]
            elif len(members):
                d = 0
                while True:
                    tries = np.arange(d, d + _TRIES, dtype=np.uint64)[:, None]
                    slots = (mixed(hashes[members] + tries * _STEP) % np.uint64(n)).astype(np.int64)
                    ordered = np.sort(slots, axis=1)
                    good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                    if good.any():
                        self.shift[b] = d + int(good.argmax())
                        slots = slots[good.argmax()]
                        break
                    d += _TRIES
            else:
                continue
            free[slots] = False
            self.keys[slots], self.values[slots] = hashes[members], members

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash among the keys, -1 if it is none of them."""
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = (mixed(hashes + np.maximum(shift, 0).astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)
        slots = np.where(shift < 0, -1 - shift, slots)
        return np.where(self.keys[slots] == hashes, self.values[slots], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is known."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0: merged into the one before
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of its parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary; built on the driver, sent once to each executor."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.whole = PerfectHash(span_hashes(self.bytes, self.begins, self.begins + self.sizes))
        self._local()

    def _local(self) -> None:
        self.ranks: dict[bytes, int] = {}
        self.table: PieceTable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ranks": {}, "table": None}

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that were not seen before: first tier whole, second tier merged."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        whole = self.whole.find(span_hashes(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends))
        ids, counts = [], np.ones(len(pieces), np.int64)
        for k, (piece, known) in enumerate(zip(pieces, whole.tolist())):
            if known >= 0 and self.tokens[known] == piece:
                ids.append(known)
            else:
                merged = merge_bytes(piece, self.ranks)
                ids += merged
                counts[k] = len(merged)
        return np.array(ids, np.uint16), counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.ranks:
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
        if self.table is None:
            self.table = PieceTable()
        return encode_texts(raw, offsets, self.table, self._pieces)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id runs in a row, and the offset of each run's bytes."""
        sizes = self.sizes[ids]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[ragged(self.begins[ids], sizes)], before[offsets]


def encode_and_decode(docs: DataFrame, tokens: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` bytes.

    A null text is an empty one and has no ids. Equal rows give equal rows, a null id stays, other
    columns are left out. Texts are cut into pre-tokens whole, whatever their length. Vocabularies
    of up to 65,536 tokens are supported; every single byte must be a token.
    """
    if len(tokens) > 1 << 16:
        raise ValueError("more than 65,536 tokens")
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(tokens))
    names = [id_col, "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in passes(batches, "text"):
            ids, at = bpe.encode(*text_bytes(batch.column(1)))
            out, out_at = bpe.decode(ids, at)
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(at)),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(4 * at), pa.py_buffer(ids)]).cast(pa.binary()),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(out_at), pa.py_buffer(out)]).cast(pa.binary()),
            ], names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("n_tokens", T.LongType())
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema.add("ids", T.BinaryType()).add("decoded", T.BinaryType()))
