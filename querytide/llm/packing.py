"""Packing of documents into training sequences by lexical retrieval.

Whole windows of a document are sequences of their own. What is left of it, its tail, is put beside its
nearest tails: shards of a bounded number of tails, dealt by their rarest tokens, each hold a BM25
inverted index; an unused tail opens a sequence, and its best unused neighbours fill it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.llm.common import filled, passes, text_bytes
from querytide.llm.pretokens import PieceTable, encode_texts, ragged
from querytide.session import staged

WINDOW = 1024
END_ID = 0
SHARD_TAILS = 1024
VOCABULARY = 1 << 16
K1, B = 1.2, 0.75
_JOINED = 1000
# Bytes of text that one pass works on; its arrays are eight times that, and more of them cost more time and memory.
PASS_BYTES = 1 << 18


class Tokenizer:
    """Ids of pre-tokens by the ``tokenizers`` library, each distinct one asked for once while the table holds it.

    As the library does unless told otherwise, the special tokens of the file are found in texts; a text
    that holds one is given to the library whole. The file has to be a byte-level BPE with the usual
    pattern, a token for the line break and at most 65,536 tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Loaded

        self.loaded = Loaded.from_file(path)
        self.added = [t.content for t in self.loaded.get_added_tokens_decoder().values()]
        self.table = PieceTable()
        breaks = self._ids(["\n"])[0]
        if len(breaks) != 1 or self.loaded.get_vocab_size() > VOCABULARY:
            raise ValueError(f"no byte-level vocabulary of at most {VOCABULARY} tokens: {path}")
        self.newline = breaks[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.loaded.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        blank = [t.isspace() for t in texts]
        # Pieces of one line each stand between line breaks, which are tokens of their own and split the ids again.
        plain = [t for t, b in zip(texts, blank) if not b]
        joined = self._ids(["\n".join(plain[i : i + _JOINED]) + "\n" for i in range(0, len(plain), _JOINED)])
        ids = np.fromiter(chain.from_iterable(joined), np.uint16, sum(map(len, joined)))
        breaks = np.flatnonzero(ids == self.newline)
        sizes = np.diff(np.concatenate([[-1], breaks])) - 1
        ids = ids[ids != self.newline]
        if any(blank):
            spaces = iter(self._ids([t for t, b in zip(texts, blank) if b]))
            runs = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
            parts = [np.array(next(spaces), np.uint16) if b else next(runs) for b in blank]
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = filled(column)
        marked = np.zeros(len(column), bool)
        for token in self.added:
            marked |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return encode_texts(*text_bytes(column), self.table, self._pieces)
        ids, at = encode_texts(*text_bytes(pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), column)), self.table, self._pieces)
        whole = iter(self._ids(column.filter(pa.array(marked)).to_pylist()))
        parts = [np.array(next(whole), np.uint16) if m else ids[b:e] for m, b, e in zip(marked.tolist(), at[:-1].tolist(), at[1:].tolist())]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer in each process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _distinct(ids: np.ndarray) -> np.ndarray:
    """The different ids in order, by radix sort."""
    ordered = np.sort(ids, kind="stable")
    first = np.empty(len(ordered), bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def _tokenized(path: str, names: list[str]):
    """Per document its full windows' checksums, its tail and the tail's rarest tokens; per run the tails' token counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(VOCABULARY, np.int64)
        tails = tokens = 0
        kind = None
        for batch in passes(batches, "text", PASS_BYTES):
            kind = batch.schema.field(0).type
            ids, at = tokenizer(path).encode(batch.column(1))
            columns: list[list] = [[] for _ in range(6)]
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[begin:end], np.uint16(END_ID))
                full = len(own) // WINDOW
                tail = own[full * WINDOW :]
                terms = _distinct(tail)
                held[terms] += 1
                tails, tokens = tails + bool(len(tail)), tokens + len(tail)
                rare = terms[-3:][::-1].tolist() + [-1, -1, -1]
                row = (len(own), [checksum(own[k * WINDOW : (k + 1) * WINDOW]) for k in range(full)], tail.tobytes(), *rare[:3])
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.int32()] * 3]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.int64())], names)
        if kind is not None:
            terms = np.flatnonzero(held)
            keys, counts = np.append(terms, [-1, -2]), np.append(held[terms], [tails, tokens])  # -1: tails, -2: their tokens
            nothing = [pa.nulls(len(keys), k) for k in (kind, pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.int32()] * 3)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(keys, pa.int32()), pa.array(counts, pa.int64())], names)

    return run


class Shard:
    """An inverted index over some tails, and the greedy filling of sequences from it."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.tails = tails
        self.left = np.array([len(t) for t in tails], np.int64)
        self.begin = np.zeros(len(tails), np.int64)
        terms = [np.unique(t, return_counts=True) for t in tails]
        self.terms = [t[idf[t] > 0] for t, _ in terms]
        kept = [c[idf[t] > 0] for t, c in terms]
        sizes = np.array([len(t) for t in self.terms], np.int64)
        owner = np.repeat(np.arange(len(tails)), sizes)
        term = np.concatenate(self.terms) if len(tails) else np.zeros(0, np.uint16)
        often = np.concatenate(kept).astype(np.float64) if len(tails) else np.zeros(0)
        norm = K1 * (1 - B + B * self.left[owner] / mean_length)
        order = np.argsort(term, kind="stable")
        self.owner = owner[order]
        self.weight = (idf[term] * often * (K1 + 1) / (often + norm))[order]
        self.first = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail for the distinct tokens of the seed."""
        terms = self.terms[seed].astype(np.int64)
        at = ragged(self.first[terms], self.first[terms + 1] - self.first[terms])
        return np.bincount(self.owner[at], self.weight[at], len(self.tails))

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (tail, begin, length); every token is in one of them, and only the last one is short."""
        for seed in range(len(self.tails)):
            if not self.left[seed]:
                continue
            room = WINDOW
            pieces = [self._take(seed, room)]
            room -= pieces[0][2]
            score = self.scores(seed)
            while room:
                score[self.left == 0] = -1.0
                fits = np.where(self.left <= room, score, -1.0)
                best = int(fits.argmax())
                if fits[best] < 0:  # the best of the longer ones is cut
                    best = int(score.argmax())
                    if score[best] < 0:
                        break
                pieces.append(self._take(best, room))
                room -= pieces[-1][2]
            yield pieces

    def _take(self, tail: int, room: int) -> tuple[int, int, int]:
        piece = (tail, int(self.begin[tail]), int(min(room, self.left[tail])))
        self.begin[tail] += piece[2]
        self.left[tail] -= piece[2]
        return piece


def _packed(statistics, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean_length = statistics.value
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for doc, total, windows, _ in waiting:
                for k, crc in enumerate(windows):
                    rows.append((doc, k * WINDOW, WINDOW, crc, total, sequence, 0))
                    sequence += 1
            units = [(doc, total, len(windows) * WINDOW, np.frombuffer(tail, np.uint16)) for doc, total, windows, tail in waiting if tail]
            for pieces in Shard([u[3] for u in units], idf, mean_length).sequences():
                offset = 0
                for tail, begin, length in pieces:
                    doc, total, before, ids = units[tail]
                    rows.append((doc, before + begin, length, checksum(ids[begin : begin + length]), total, sequence, offset))
                    offset += length
                sequence += 1
            waiting.clear()
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                waiting.append(row)
                if len(waiting) == SHARD_TAILS:
                    yield flush()
        if waiting:
            yield flush()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids and an end id; a null text is an empty one and has the end id alone. Every id is in
    one piece, and every sequence is full but for the last of each shard. Rows are documents whatever their
    ids, so repeated rows are packed each; a null id stays null. Extra columns are left out. No document
    is dropped; an empty table gives no rows. ``path`` is the tokenizer file, which all executors must have.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType
    names = ["doc", "doc_tokens", "windows", "tail", "k1", "k2", "k3", "term", "n"]
    schema = T.StructType([T.StructField("doc", kind)]).add("doc_tokens", "long").add("windows", T.ArrayType(T.LongType())).add("tail", "binary")
    for name, what in (("k1", "integer"), ("k2", "integer"), ("k3", "integer"), ("term", "integer"), ("n", "long")):
        schema = schema.add(name, what)
    rows = staged(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_tokenized(path, names), schema), "tokens")

    counts = dict(rows.where("term IS NOT NULL").groupBy("term").agg(F.sum("n")).collect())  # a row per token of the vocabulary at most
    tails, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    idf = np.zeros(VOCABULARY)
    for term, n in counts.items():
        idf[term] = max(0.0, np.log((tails - n + 0.5) / (n + 0.5)))
    statistics = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, tokens / max(1, tails))))

    # Tails with the same rare tokens stand together, and any number of them is cut into shards by count.
    order = ["k1", "k2", "k3", "doc"]
    units = rows.where("term IS NULL").select("doc", "doc_tokens", "windows", "tail", "k1", "k2", "k3")
    units = units.repartitionByRange(*order).sortWithinPartitions(*order, "tail").select("doc", "doc_tokens", "windows", "tail")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    return units.mapInArrow(_packed(statistics, names), schema)
