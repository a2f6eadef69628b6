"""Documents whose word shingles agree to a share or more: prefix filters under several global orders, then a count.

Two sets can only reach a similarity t if they share one of the first n - ceil(t n) + 1 tokens, under any
order of tokens that is the same for all sets. Candidates must do so under three orders:

* A: hot tokens last, then by the frequency that the words of a shingle make one expect, rarest first;
* B: hot tokens last, then by hash;
* C: hot tokens last, then by another hash.

Sketches of fixed size, counted over all documents, tell which tokens are hot and how frequent words are.
They only shape the orders: every count gives a valid order, so nothing is lost by their collisions.

Before the orders B and C, and before the count, parity sketches are looked at: each token flips one bit, so two
sketches differ in no more bits than the sets do in tokens, and a pair with too many can't be similar enough. One of
512 bits goes with every shared token; one of at least two bits a token stays with the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.llm.common import mixed, passes, shingle_sets, text_bytes, word_hashes
from querytide.llm.components import components
from querytide.session import drop_staged, staged

SHINGLE_BITS = 20
WORD_BITS = 18
CHUNK = 4096
# Parity sketch, in words of 64 bits.
PARITY = [f"o{i}" for i in range(8)]
# Rows of ids or tokens, of 16 bytes, up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_SALTS = mixed(np.arange(11, 20, dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hash(tokens: np.ndarray) -> int:
    """64 bits for a set of tokens; equal sets are one class."""
    return int(_signed(mixed(np.array([(mixed(tokens ^ _SALTS[7])).sum(dtype=np.uint64) ^ mixed(np.uint64([len(tokens)]))[0]], np.uint64)))[0])


def _sets(width: int, names: list[str]):
    """Per document its class and size; per batch run the two sketches, in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = [np.zeros(1 << SHINGLE_BITS, np.uint32), np.zeros(1 << WORD_BITS, np.uint32)]
        kind = None
        for batch in passes(batches, "text"):
            kind = batch.schema.field(0).type
            raw, offsets = text_bytes(batch.column(1))
            sets = shingle_sets(raw, offsets, width)
            words, _ = word_hashes(raw, offsets)
            if len(words):
                sketch[1] += np.bincount((words >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS).astype(np.uint32)
                tokens = np.concatenate(sets)
                sketch[0] += np.bincount((tokens >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64), minlength=1 << SHINGLE_BITS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
            ], names)
        if kind is not None:
            counts = np.concatenate(sketch).reshape(-1, CHUNK)
            held = np.flatnonzero(counts.any(axis=1))
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(held), kind), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()),
                pa.array(held.astype(np.int32)), pa.array([counts[h].tobytes() for h in held], pa.binary()),
            ], names)

    return run


def _add_up(pdf):
    total = np.zeros(CHUNK, np.uint64)
    for part in pdf["counts"]:
        total += np.frombuffer(part, np.uint32)
    return pdf.iloc[:1].assign(counts=[total.tobytes()])[["chunk", "counts"]]


def _sketches(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hot class per shingle bucket and a frequency class per word bucket, one byte each: a fixed size."""
    parts = rows.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(_add_up, "chunk int, counts binary").collect()
    total = np.zeros(((1 << SHINGLE_BITS) + (1 << WORD_BITS)) // CHUNK * CHUNK, np.uint64).reshape(-1, CHUNK)
    for chunk, counts in parts:
        total[chunk] = np.frombuffer(counts, np.uint64)
    total = total.ravel()
    shingles, words = total[: 1 << SHINGLE_BITS], total[1 << SHINGLE_BITS :]
    usual = 2.0 * np.median(shingles) + 8
    hot = np.floor(np.log2(np.maximum(shingles / usual, 1))).astype(np.uint8)
    return hot, np.round(2 * np.log2(words.astype(np.float64) + 1)).astype(np.uint8)


def _prefixes(width: int, similarity: int, sketches, names: list[str]):
    """Per document class its size, smallest hashes, share of hot tokens and prefixes under the three orders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_of, often_of = sketches.value
        for batch in passes(batches, "text"):
            raw, offsets = text_bytes(batch.column(1))
            words, bounds = word_hashes(raw, offsets)
            often = often_of[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.uint64)
            expected = np.zeros(max(0, len(words) - width + 1), np.uint64)
            for k in range(width if len(expected) else 0):
                expected += often[k : k + len(expected)]
            columns: list[list] = [[] for _ in names]
            for tokens, first, begin, end in zip(*shingle_sets(raw, offsets, width, True), bounds[:-1].tolist(), bounds[1:].tolist()):
                n = len(tokens)
                if not n:
                    continue
                p = n - -(-similarity * n // 100) + 1
                hot = hot_of[(tokens >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)].astype(np.uint64)
                rarity = expected[begin + first] if end - begin >= width else np.zeros(n, np.uint64)
                keys = [mixed(tokens ^ s) for s in _SALTS[:3]]
                orders = [hot << np.uint64(58) | rarity << np.uint64(48) | keys[0] >> np.uint64(16)]
                orders += [hot << np.uint64(58) | k >> np.uint64(6) for k in keys[1:]]
                heads = [np.argpartition(o, p - 1)[:p] if p < n else np.arange(n) for o in orders]
                low = [int(_signed(mixed(tokens ^ s).min(keepdims=True))[0]) for s in _SALTS[3:6]]
                flips = np.bincount((mixed(tokens ^ _SALTS[6]) >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITY)) & 1
                parity = np.packbits(flips.astype(np.uint8)).view(np.int64).tolist()
                wide = max(64, 1 << (2 * n - 1).bit_length())
                flips = np.bincount((mixed(tokens ^ _SALTS[6]) & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
                wide_parity = np.packbits(flips.astype(np.uint8)).view(np.int64)
                # Sixteen bits of the tokens will do for B and C, where equal ones are only looked for in pairs.
                others = [(keys[k][heads[k]] >> np.uint64(48)).astype(np.uint16).view(np.int16) for k in (1, 2)]
                row = (set_hash(tokens), n, float(hot.mean()), *low, *parity, wide_parity, _signed(tokens[heads[0]]), *others)
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * (3 + len(PARITY)), *[pa.list_(pa.int64())] * 2, pa.list_(pa.int16()), pa.list_(pa.int16())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _token_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            sets = shingle_sets(*text_bytes(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))], ["node", "tokens"])

    return run


def _flips(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    size = F.least(F.size(a), F.size(b))

    def fold(s: Column) -> Column:
        halves = F.zip_with(F.slice(s, F.lit(1), size), F.slice(s, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(s) > size, halves).otherwise(s)

    return F.aggregate(F.zip_with(fold(a), fold(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, v: n + v)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, firsts: DataFrame, width: int, similarity: int, label: str) -> DataFrame:
    """Those of the ``pairs`` (x, y) of classes whose sets are similar enough, written out. ``pairs`` is a written table and deleted."""
    wide = [classes.select(F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("parity").alias(f"p{e}")) for e in "xy"]
    few = (100 + similarity) * _flips(F.col("px"), F.col("py")) <= (100 - similarity) * (F.col("nx") + F.col("ny"))
    asked, pairs = pairs, staged(pairs.join(wide[0], "x").join(wide[1], "y").where(few).select("x", "y"), f"{label}-pairs")
    drop_staged(asked)
    nodes = staged(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(firsts, "node"), f"{label}-nodes")
    ids = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    # A class's text is that of any row with its id whose set has its hash: with repeated ids there may be several texts.
    texts = docs.join(ids, "doc").select("node", "text")
    own = staged(texts.mapInArrow(_own_sets(width), "node long, tokens array<long>").dropDuplicates(["node"]), f"{label}-sets")
    x, y = own.select(F.col("node").alias("x"), F.col("tokens").alias("tx")), own.select(F.col("node").alias("y"), F.col("tokens").alias("ty"))
    common = F.size(F.array_intersect("tx", "ty"))
    both = pairs.join(x, "x").join(y, "y")
    links = staged(both.where(100 * common >= similarity * (F.size("tx") + F.size("ty") - common)).select("x", "y"), f"{label}-links")
    drop_staged(pairs, nodes, own)
    return links


def _own_sets(width: int):
    """Like ``_token_sets``, less the rows whose set isn't that of their class."""
    inner = _token_sets(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            hashes = [set_hash(np.asarray(t, np.int64).view(np.uint64)) if len(t) else None for t in batch.column(1).to_pylist()]
            yield batch.filter(pa.array([h == n for h, n in zip(hashes, batch.column(0).to_pylist())], pa.bool_()))

    return run


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: int = 90) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``node`` (class of equal sets) and ``component_id``.

    Two rows link when 100 x (common shingles) >= ``similarity`` x (shingles of both); ``component_id`` is the
    smallest id that links lead to, itself included. Shingles are hashed to 64 bits. A row without words
    (null, empty or only white space) has no shingle, no link and its own id. Rows that share an id are
    separate rows with their own texts. Null ids don't count for the smallest one. Extra columns are left out.
    """
    if not 50 <= similarity <= 100:
        raise ValueError("similarity is a percentage from 50 to 100")
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = docs.schema["doc"].dataType
    names = ["doc", "n", "node", "chunk", "counts"]
    schema = T.StructType([T.StructField("doc", kind)]).add("n", "long").add("node", "long").add("chunk", "integer").add("counts", "binary")
    rows = staged(docs.mapInArrow(_sets(width, names), schema), "sets")
    sketches = docs.sparkSession.sparkContext.broadcast(_sketches(rows))
    rows = rows.where("chunk IS NULL").select("doc", "n", "node")
    firsts = staged(rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc")), "classes")

    names = ["node", "n", "hot", "m0", "m1", "m2", *PARITY, "parity", "a", "b", "c"]
    schema = "node long, n long, hot double, m0 long, m1 long, m2 long, " + "".join(f"{o} long, " for o in PARITY) + "parity array<long>, a array<long>, b array<short>, c array<short>"
    classes = docs.mapInArrow(_prefixes(width, similarity, sketches, names), schema).dropDuplicates(["node"])
    classes = staged(classes, "prefixes")

    # First link classes to the most usual one of those that share two smallest hashes: stars, so linear in a group's size.
    # What is connected by them needs no further comparison, however large the group.
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), f"m{i}", f"m{j}") for i, j in ((0, 1), (1, 2), (0, 2))]))
    keyed = staged(classes.select("node", "n", "hot", keys.alias("key")), "keyed")
    centres = keyed.groupBy("key").agg(F.max(F.struct("hot", "n", "node")).alias("top"), F.count("*").alias("size")).where("size > 1")
    centres = staged(centres.select("key", F.col("top.node").alias("y"), F.col("top.n").alias("ny")), "centres")
    alike = 100 * F.least("n", "ny") >= similarity * F.greatest("n", "ny")
    stars = keyed.join(centres, "key").where(alike & (F.col("node") != F.col("y"))).select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y")).distinct()
    stars = staged(stars, "stars")
    drop_staged(keyed, centres)
    stars = _verified(stars, classes, docs, firsts, width, similarity, "stars")
    joined = staged(components(stars), "joined")

    # Then every pair that shares a prefix token under each order and isn't connected yet.
    near = classes.join(joined, "node", "left").withColumn("part", F.coalesce("component", "node"))
    held = near.select("node", "part", F.explode("a").alias("token"))
    tokens = staged(held.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token"), "tokens")
    carried = ["node", "part", "n", *PARITY]
    held = held.select("node", "token").join(F.broadcast(tokens) if tokens.count() <= BROADCAST_ROWS else tokens, "token").join(near.select(*carried), "node")
    held = staged(held.select("token", *carried), "held")
    drop_staged(tokens)
    x = held.select(F.col("token").alias("tokenx"), *[F.col(c).alias(f"{c}x") for c in carried])
    y = held.select(F.col("token").alias("tokeny"), *[F.col(c).alias(f"{c}y") for c in carried])
    flipped = sum((F.bit_count(F.col(f"{o}x").bitwiseXOR(F.col(f"{o}y"))) for o in PARITY), F.lit(0))
    pairs = x.join(
        y.hint("merge"),
        (F.col("tokenx") == F.col("tokeny")) & (F.col("nodex") < F.col("nodey")) & (F.col("partx") != F.col("party"))
        & (100 * F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
        & ((100 + similarity) * flipped <= (100 - similarity) * (F.col("nx") + F.col("ny"))),
    ).select(F.col("nodex").alias("x"), F.col("nodey").alias("y")).distinct()
    candidates = staged(pairs, "candidates")
    drop_staged(held)
    bx, by = (classes.select(F.col("node").alias(e), F.col("b").alias(f"b{e}"), F.col("c").alias(f"c{e}")) for e in "xy")
    pairs = candidates.join(bx, "x").join(by, "y").where(F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy")).select("x", "y")
    pairs = staged(pairs, "ordered")
    drop_staged(candidates)
    links = _verified(pairs, classes, docs, firsts, width, similarity, "pairs")
    drop_staged(classes)

    found = staged(components(joined.toDF("x", "y").union(links)), "components")
    smallest = found.join(firsts, "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    lowest = found.join(staged(smallest, "smallest"), "component").select("node", "component_id")
    lowest = staged(firsts.join(lowest, "node", "left").select("node", F.coalesce("component_id", "doc").alias("component_id")), "lowest")
    out = rows.join(lowest, "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` less all but one row of each group of near copies: the row with the smallest id stays.

    Rows without words and rows without an id stay. Rows that share an id stay or go together, but of those
    with one id and one text a single one stays.
    """
    linked = staged(link_documents(docs, id_col, text_col, width, similarity), "linked")
    dropped = linked.where((F.col("n_shingles") > 0) & (F.col(id_col) != F.col("component_id"))).select(id_col).distinct()
    repeated = staged(linked.groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    kept = docs.join(dropped, id_col, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, id_col, "left_anti").unionByName(again).select(*docs.columns)
