"""Vector code compression: product codes whose entries are found by equal-average search.

A vector is cut into equal parts and every part is replaced by the number of the nearest entry in its position's
codebook. Entries stand in the order of their component sums; the search starts at the part's own sum and goes
outward, until the squared gap of the sums over the dimension is strictly larger than the best distance found, since
no entry further out can be as near.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.whole_vectors import matrix, usable, whole_numbers
from querytide.session import staged

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Parts whose distances are worked out at once.
PASS_ROWS = 4096
# A label is hot if it has at least one in so many rows; there are no more hot labels than this.
HOT_SHARE = 1000


class Codebooks(NamedTuple):
    """``entries``: parts x entries x width, whole numbers (components times ``scale``, rounded down)."""

    entries: np.ndarray
    scale: int

    @property
    def digest(self) -> str:
        """SHA-256 of all components as decimal text, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row (ties: the lower index), and its squared distance."""
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    n, width, own = len(book), book.shape[1], x.sum(axis=1)
    far = np.iinfo(np.int64).max
    best, at = np.full(len(x), far // max(1, width)), np.full(len(x), n)
    right = np.searchsorted(sums, own)
    left, going = right - 1, np.arange(len(x))
    for _ in range(n):
        low, high, mean = left[going], right[going], own[going]
        gap_low = np.where(low >= 0, mean - sums[np.maximum(low, 0)], far)
        gap_high = np.where(high < n, sums[np.minimum(high, n - 1)] - mean, far)
        down = gap_low <= gap_high
        gap = np.where(down, gap_low, gap_high)
        on = gap * gap <= width * best[going]
        going, down, low, high = going[on], down[on], low[on], high[on]
        if not len(going):
            break
        entry = order[np.where(down, low, high)]
        distance = ((x[going] - book[entry]) ** 2).sum(axis=1)
        better = (distance < best[going]) | ((distance == best[going]) & (entry < at[going]))
        best[going[better]], at[going[better]] = distance[better], entry[better]
        left[going[down]] -= 1
        right[going[~down]] += 1
    return at, best


def _assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry index and squared distance per vector and part."""
    parts, _, width = books.shape
    at, distance = (np.empty((len(vectors), parts), np.int64) for _ in range(2))
    for begin in range(0, len(vectors), PASS_ROWS):
        rows = slice(begin, begin + PASS_ROWS)
        for p in range(parts):
            at[rows, p], distance[rows, p] = nearest(vectors[rows, p * width : (p + 1) * width], books[p])
    return at, distance


def _partial_sums(books):
    """Of the vectors of a task, per part and entry how many parts chose it and their component sums."""
    def run(batches):
        entries = books.value
        parts, n, width = entries.shape
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("v"))
            at, _ = _assigned(vectors, entries)
            for p in range(parts):
                spot = at[:, p] + p * n
                counts += np.bincount(spot, minlength=parts * n)
                np.add.at(sums, spot, vectors[:, p * width : (p + 1) * width])
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), lists], ["spot", "n", "sums"])

    return run


def _coded(books):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, distance = _assigned(matrix(batch.column("v")), books.value)
            offsets = pa.array(np.arange(batch.num_rows + 1) * at.shape[1], pa.int32())
            codes = pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), codes, pa.array(distance.sum(axis=1))], ["id", "label", "codes", "error"]
            )

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label: Column, parts: int, scale: int) -> DataFrame:
    given = F.col(f"`{vector_col}`")
    width = F.floor(F.size(given) / parts)
    kept = vectors.where(usable(given) & (F.size(given) % parts == 0))
    whole = whole_numbers(given, scale, F.floor(F.lit(1 << 30) / width))
    return kept.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), whole.alias("v"))


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all usable vectors, and the codebooks they refer to.

    The frame holds the id, ``label``, ``codes`` (an entry index per part), ``error`` (squared distance to the entries,
    summed over parts) and ``label_error`` (``error`` summed over rows of equal label, nulls together). The codebooks are
    None, and the frame is empty, where no vector is usable.

    Components become ``floor(scale * x)``, and all sums and distances are whole numbers, so results don't depend on how
    rows are dealt. Each position's codebook starts as the parts of the vectors with the ``entries`` smallest ids (null
    ids last, ties by the vector; fewer vectors give fewer entries). A round assigns all parts and replaces every
    entry that was chosen by the rounded-down mean of its parts. Only sums per part and entry reach the driver.

    Left out are vectors that are null, empty, or hold null or non-finite components, whose length isn't a multiple of
    ``parts``, or differs from the length of the first vector. Repeated rows count as often as they occur, null ids
    are coded like others, equal vectors get equal codes, extra columns are left out. A component of 2**30 over the
    width of a part, times ``scale``, or more is an error, since 64 bits can't hold its distances.
    """
    spark = vectors.sparkSession
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = staged(_kept(vectors, id_col, vector_col, label, parts, scale), "whole")
    seeds = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    kind = f"{rows.schema['id'].dataType.simpleString()}"
    schema = f"id {kind}, label {rows.schema['label'].dataType.simpleString()}, codes array<int>, error long"
    if not seeds:
        empty = spark.createDataFrame([], f"{schema}, label_error long")
        return empty.withColumnRenamed("id", id_col), None
    size = len(seeds[0].v)
    rows = rows.where(F.size("v") == size)
    if any(len(s.v) != size for s in seeds):
        seeds = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([s.v for s in seeds], np.int64).reshape(len(seeds), parts, size // parts).swapaxes(0, 1).copy()
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(books)
        sums = rows.select("v").mapInArrow(_partial_sums(known), "spot int, n long, sums array<long>")
        totals = sums.groupBy("spot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size // parts)]).alias("sums"))
        for r in totals.collect():  # parts x entries rows
            books[divmod(r.spot, books.shape[1])] = [s // r.n for s in r.sums]
        known.unpersist()
    final = spark.sparkContext.broadcast(books)
    coded = staged(rows.select("id", "label", "v").mapInArrow(_coded(final), schema), "codes")
    return _with_label_error(coded).withColumnRenamed("id", id_col), Codebooks(books, scale)


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Each row with the error of its label's rows.

    Labels with a thousandth of the rows or more (a thousand labels at most) are sent to every task, so that a label
    with a third of all rows stays where its rows are; the others meet their totals by label.
    """
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    least = coded.count() / HOT_SHARE
    hot = totals.where(F.col("_n") >= least).select(F.col("label").alias("_label"), "label_error")
    cold = totals.where(F.col("_n") < least).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    met = coded.join(F.broadcast(hot), same, "left")
    rest = met.where("label_error IS NULL").select(*coded.columns).join(cold, same)
    columns = [*coded.columns, "label_error"]
    return met.where("label_error IS NOT NULL").select(*columns).union(rest.select(*columns))


def restored(codes: Column, books: Codebooks) -> Column:
    """The vector that a list of codes stands for: its entries' components, over the scale."""
    table = F.lit([[[c / books.scale for c in entry] for entry in part] for part in books.entries.tolist()])
    return F.flatten(F.zip_with(table, codes, lambda part, code: F.get(part, code)))


def hex_code(codes: Column) -> Column:
    """Two hex digits for each code, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
