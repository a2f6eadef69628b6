"""Exact top-k search by inner product in three phases with a uniform threshold.

The components are cut into slices, and a node holds one slice of a block of vectors: all it knows of a candidate is
the part of its score that comes from the slice. First, every node lists the best parts it has for each query; the
listed candidates are scored, and the k-th best of those scores is a cutoff that the result can't fall below. Second,
nodes send every entry that reaches the cutoff over the number of slices: a candidate without such an entry in any slice sums
up to less than the cutoff. Third, candidates that could still reach it get the parts that weren't sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.llm.whole_vectors import matrix, single_vectors
from querytide.session import staged

SCALE = 256
# Nodes that a vector's components are dealt over.
SLICES = 2
# Queries and candidates that meet in a task, and queries whose scores are held at once.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
TILE = 256
# Rows of one hot vector are thinned out in so many groups first.
SALTS = 16
_NONE = np.iinfo(np.int64).min


def _exact_bound(size: Column) -> Column:
    """Components up to here have inner products below 2**53, which doubles hold exactly."""
    return F.floor(F.sqrt(F.lit(2.0**53) / size) - 1)


def _classes(vectors: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector with its ``most`` smallest ids; copies beyond those can't be in a result."""
    def smallest(rows: DataFrame, *keys) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")

    few = smallest(vectors.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "size", "v", "_salt")
    few = smallest(few.drop("_salt"), "size", "v")
    return few.groupBy("size", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "size", "v", "ids")


class _Dealt:
    """Queries and candidates of one length meet in pairs of blocks, each with bounded numbers of both."""

    def __init__(self, queries: DataFrame, candidates: DataFrame):
        # A row per length of vectors.
        n_queries = queries.groupBy("size").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qbs"))
        n_candidates = candidates.groupBy("size").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).cast("int").alias("cbs"))
        self.blocks = staged(n_queries.join(n_candidates, "size"), "blocks")
        self.queries, self.candidates = queries, candidates

    @staticmethod
    def block(id_col: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(blocks)).cast("int")

    def rows(self, cutoffs: DataFrame | None = None) -> DataFrame:
        """(``size``, ``qb``, ``cb``, ``id``, ``v``, ``ids``, ``cutoff``); ``ids`` is null for queries."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        queries = self.queries.withColumn("cutoff", F.lit(None).cast("long"))
        if cutoffs is not None:
            queries = self.queries.join(cutoffs, "id", "left")
        queries = queries.join(self.blocks, "size").withColumns({"qb": self.block("id", "qbs"), "cb": every("cbs")})
        candidates = self.candidates.join(self.blocks, "size").withColumns({"cb": self.block("id", "cbs"), "qb": every("qbs")})
        empty = lambda kind: F.lit(None).cast(kind)
        return queries.select("size", "qb", "cb", "id", "v", empty("array<long>").alias("ids"), "cutoff").union(
            candidates.select("size", "qb", "cb", "id", "v", "ids", empty("long"))
        )

    def slices(self, n: int, cutoffs: DataFrame | None = None) -> DataFrame:
        """What the nodes hold: ``rows`` with ``slice`` and ``v`` cut to it."""
        width = F.ceil(F.col("size") / n).cast("int")
        rows = self.rows(cutoffs).withColumn("slice", F.explode(F.lit(list(range(n)))))
        return rows.withColumn("v", F.slice("v", F.col("slice") * width + 1, width)).withColumn("is_query", F.col("ids").isNull()).drop("ids")

    def wanted(self, entries: DataFrame) -> DataFrame:
        """Entries (``size``, ``q``, ``slice``, ``c``, ``s``; the last two are lists of one block) with their blocks."""
        placed = entries.withColumn("_first", F.col("c")[0]).join(self.blocks, "size")
        return placed.withColumns({"qb": self.block("q", "qbs"), "cb": self.block("_first", "cbs")}).select("size", "qb", "cb", "q", "slice", "c", "s")


_ENTRY = "size int, q long, slice int, c array<long>, s array<long>"


def _local(pick):
    """A node: per query the entries whose places ``pick(scores, cutoffs)`` gives as (row, column) indices."""
    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy(zero_copy_only=False)
        there = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        (queries, candidates), ids = (matrix(t["v"], np.float64) for t in there), [t["id"].to_numpy() for t in there]
        cutoffs = there[0]["cutoff"].fill_null(_NONE).to_numpy()
        found = []
        for t in range(0, len(queries), TILE) if len(ids[1]) else ():
            scores = queries[t : t + TILE] @ candidates.T
            rows, columns = pick(scores, cutoffs[t : t + TILE])
            found.append((np.bincount(rows, minlength=len(scores)), ids[1][columns], scores[rows, columns].astype(np.int64)))
        counts = np.concatenate([f[0] for f in found]) if found else np.zeros(len(ids[0]), np.int64)
        some = counts > 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts[some])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64))) for i in (1, 2)]
        q = ids[0][some]
        same = [pa.array(np.full(len(q), table[name][0].as_py() if table.num_rows else 0, np.int32)) for name in ("size", "slice")]
        return pa.table([same[0], pa.array(q), same[1], *lists], ["size", "q", "slice", "c", "s"])

    return run


def _best(k: int):
    def pick(scores, cutoffs):
        few = min(k, scores.shape[1])
        return np.repeat(np.arange(len(scores)), few), np.argpartition(-scores, few - 1, axis=1)[:, :few].ravel()

    return pick


def _reaching(slices: int):
    def pick(scores, cutoffs):
        return np.nonzero(scores * slices >= np.where(cutoffs == _NONE, -np.inf, cutoffs.astype(np.float64))[:, None])

    return pick


def _resolved(k: int, slices: int, prune: bool):
    """Of a pair of blocks: whole scores of the candidates with entries, the ``k`` best per query.

    With ``prune`` a candidate goes whose known parts, plus the most that parts below the threshold can add, stay below the cutoff.
    """
    def run(vectors: pa.Table, entries: pa.Table) -> pa.Table:
        is_query = vectors["ids"].is_null().to_numpy(zero_copy_only=False)
        queries, candidates = vectors.filter(pa.array(is_query)), vectors.filter(pa.array(~is_query))
        candidates = candidates.sort_by("id")
        c_ids, lists = candidates["id"].to_numpy(), candidates["ids"].combine_chunks()
        places, parts = matrix(candidates["v"]), matrix(queries["v"])
        row_of = {q: i for i, q in enumerate(queries["id"].to_pylist())}
        cutoffs = queries["cutoff"].fill_null(_NONE).to_numpy()
        width = -(-places.shape[1] // slices)
        by_query: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        c_lists, s_lists = entries["c"].combine_chunks(), entries["s"].combine_chunks()
        for i, (q, j) in enumerate(zip(entries["q"].to_pylist(), entries["slice"].to_pylist())):
            by_query.setdefault(q, []).append((j, c_lists[i].values.to_numpy(), s_lists[i].values.to_numpy()))
        out: tuple[list, list, list] = ([], [], [])
        for q, sent in by_query.items():
            row = row_of[q]
            known, have = np.zeros(len(c_ids), np.int64), np.zeros((slices, len(c_ids)), bool)
            for j, c, s in sent:
                at = np.searchsorted(c_ids, c)
                known[at] += s
                have[j, at] = True
            left = np.flatnonzero(have.any(axis=0))
            cutoff = int(cutoffs[row])
            if prune and cutoff != _NONE:
                lacking = slices - have[:, left].sum(axis=0)
                left = left[known[left] + lacking * ((cutoff - 1) // slices) >= cutoff]
            total = known[left]
            for j in range(slices):
                need = ~have[j, left]
                part = slice(j * width, (j + 1) * width)
                total[need] += places[left[need], part] @ parts[row, part]
            first = np.lexsort((c_ids[left], -total))[:k]
            out[0].append(np.full(len(first), q, np.int64))
            out[1].append(left[first])
            out[2].append(total[first])
        at = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)
        column = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.table([column(out[0]), pa.array(c_ids[at]), lists.take(pa.array(at)), column(out[2])], ["q", "c", "ids", "score"])

    return run


def _first(rows: DataFrame, keys, order, most: int, place: str = "_place") -> DataFrame:
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= most)


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    slices: int = SLICES,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` candidates with the largest inner products per query.

    Components become ``floor(scale * x)``; ties go to the smaller id; a candidate with the query's own id is left out; a
    query with fewer candidates has all of them. Vectors of different lengths have no score. Rows whose id is null or
    whose vector is null, empty, or holds null or non-finite components take no part; of rows with one id the smallest
    vector counts. Equal vectors are searched once, under their smallest ids. Extra columns are left out. Components
    whose inner products could pass 2**53 are an error.
    """
    key = ["size", "qb", "cb"]
    asked = staged(single_vectors(queries, id_col, vector_col, scale, _exact_bound), "queries")
    # One more, for the query itself.
    known = staged(_classes(single_vectors(candidates, id_col, vector_col, scale, _exact_bound), k + 1), "candidates")
    dealt = _Dealt(asked, known)

    def node(pick, cutoffs=None):
        return dealt.slices(slices, cutoffs).groupBy(*key, "slice").applyInArrow(_local(pick), _ENTRY)

    def resolve(entries: DataFrame, cutoffs=None, prune=False):
        sides = dealt.rows(cutoffs).groupBy(*key), dealt.wanted(entries).groupBy(*key)
        return sides[0].cogroup(sides[1]).applyInArrow(_resolved(k + 1, slices, prune), "q long, c long, ids array<long>, score long")

    pairs = node(_best(k + 1)).select("size", "q", "slice", F.explode(F.arrays_zip("c", "s")).alias("e"))
    listed = _first(pairs.select("size", "q", "slice", "e.*"), ["q", "slice"], [F.desc("s"), "c"], k + 1)
    listed = listed.select("size", "q", "slice", F.array("c").alias("c"), F.array("s").alias("s"))
    scored = _first(resolve(listed), ["q"], [F.desc("score"), "c"], k + 1)
    cutoffs = staged(scored.where(F.col("_place") == k + 1).select(F.col("q").alias("id"), F.col("score").alias("cutoff")), "cutoffs")
    entries = staged(node(_reaching(slices), cutoffs), "entries")
    best = _first(resolve(entries, cutoffs, True), ["q"], [F.desc("score"), "c"], k + 1)
    rows = best.select("q", "score", F.explode("ids").alias("vec_id")).where("vec_id != q")
    ranked = _first(rows, ["q"], [F.desc("score"), "vec_id"], k, "rank")
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")
