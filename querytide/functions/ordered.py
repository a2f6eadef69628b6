"""Ordered computations that no single key can overload.

``Window.partitionBy(key)`` sends all rows of a key to one task. Here the order ``(keys, order)`` is cut into chunks of
about equal size at split points taken from a sample, so a hot key is spread over as many chunks as its size asks for,
whatever the order column looks like. A row's chunk follows from comparing it with the split points, so it is
the same in every evaluation and nothing has to be written. Rows are shuffled once, to their chunk; a window
runs inside each chunk. Only a key that a split point falls in goes on from one chunk to the next, so what earlier
chunks contribute is a table of a few rows per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
# Rows of a chunk, until there are as many chunks as this; then they grow.
CHUNK_ROWS = 1 << 16
MOST_CHUNKS = 2048
# Split points are chosen from rows with the smallest hashes: so many per chunk, and so many at first, which tells the number of rows.
SAMPLE_PER_CHUNK = 8
SAMPLE_ROWS = 1 << 10


def _in_order(point: tuple) -> tuple:
    """Sort key that orders values as Spark does: NULL first, NaN last."""
    return tuple((0,) if v is None else (2,) if v != v else (1, v) for v in point)


def _split_points(df: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """Values of ``columns`` that cut the rows into chunks of about equal size."""
    hashed = df.select(*columns, F.xxhash64(*columns).alias("_h"))
    wanted, bound = SAMPLE_ROWS, None
    while True:
        # Each task sends its smallest hashes, as many as wanted; below a bound these are little more than the sample in all.
        some = hashed if bound is None else hashed.where(F.col("_h") <= bound)
        sample = some.orderBy("_h").limit(wanted).collect()
        if bound is not None and len(sample) < wanted:
            bound = None
            continue
        n = len(sample)
        if n == wanted:  # the share of all hashes below the last one tells the number of rows
            n = int(n * 2.0**64 / max(1.0, sample[-1]["_h"] + 2.0**63))
        chunks = min(MOST_CHUNKS, math.ceil(n / CHUNK_ROWS))
        if len(sample) < wanted or wanted >= SAMPLE_PER_CHUNK * chunks:
            break
        wanted = SAMPLE_PER_CHUNK * chunks
        share = 1.5 * wanted / n
        bound = int(share * 2.0**64 - 2.0**63) if share < 1 else None
    if chunks < 2:
        return []
    ordered = sorted((tuple(r)[:-1] for r in sample), key=_in_order)
    points = [ordered[i * len(ordered) // chunks] for i in range(1, chunks)]
    return [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]


def _literal(point: tuple, df: DataFrame, columns: Sequence[str]) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(point, columns)])


def _literals(points: Sequence[tuple], df: DataFrame, columns: Sequence[str]) -> Column:
    return F.array(*[_literal(p, df, columns) for p in points])


def _with_chunk(df: DataFrame, points: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Adds how many split points a row does not come before, by binary search: a column per step, each in compiled code."""
    row, at = F.struct(*columns), F.col(CHUNK)
    rows = df.withColumn(CHUNK, F.lit(0))
    for bit in reversed(range(len(points).bit_length())):
        step = 1 << bit
        # The points that this step may look at.
        some = _literals(points[step - 1 :: 2 * step], df, columns)
        rows = rows.withColumn(CHUNK, F.when(F.get(some, F.shiftright(at, bit + 1)) <= row, at + step).otherwise(at))
    return rows


class OrderedRows:
    """Rows in the order ``keys + order``; ``order`` must not leave ties.

    ``keys`` must not hold NULLs. The rows are evaluated for the sample (these columns only), for the totals of cut keys and
    for the shuffle, so an expensive or random input is to be written first.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys = list(keys)
        self.order = list(order)
        columns = [*self.keys, *self.order]
        points = _split_points(df, columns)
        chunk = _with_chunk(df, points, columns)
        # Keys that a split point falls in, and perhaps another of the same hash. Told from the keys alone, so that
        # rows of other keys are left out before their chunk is looked for.
        spans = F.lit(bool(points))
        if self.keys and points:
            cut = sorted({p[: len(self.keys)] for p in points}, key=repr)
            known = [F.xxhash64(*[F.lit(v).cast(df.schema[c].dataType) for v, c in zip(key, self.keys)]) for key in cut]
            spans = F.xxhash64(*self.keys).isin(known)
        self._unshuffled = chunk.withColumn("_spans", spans)
        self.df, self._extended = self._unshuffled.repartitionById(len(points) + 1, F.col(CHUNK)), False

    def _extend(self, rows: DataFrame) -> OrderedRows:
        self.df, self._extended = rows, True
        return self

    @property
    def _inside(self):
        return Window.partitionBy(CHUNK, *self.keys).orderBy(*self.order)

    @property
    def _chunks(self):
        # At most two keys of a chunk are cut, so these are a few rows per chunk.
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def _totals(self, of_input: bool, **aggregates: Column) -> DataFrame:
        """Per chunk and cut key, from rows before their shuffle unless columns may be needed that were added after it."""
        rows = self._unshuffled if of_input else self.df
        return rows.where("_spans").groupBy(CHUNK, *self.keys).agg(*[c.alias(n) for n, c in aggregates.items()])

    def _join_chunks(self, rows: DataFrame, chunks: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(chunks), [CHUNK, *self.keys], "left")

    def _add_accumulated(self, values: Mapping[str, Column], total, combine) -> OrderedRows:
        names = list(values)
        inside = self._inside.rowsBetween(Window.unboundedPreceding, 0)
        earlier = self._chunks.rowsBetween(Window.unboundedPreceding, -1)
        chunks = self._totals(not self._extended, **{f"_c_{n}": total(values[n]) for n in names}).select(
            CHUNK, *self.keys, *[total(f"_c_{n}").over(earlier).alias(f"_b_{n}") for n in names]
        )
        rows = self.df.withColumns({n: total(values[n]).over(inside) for n in names})
        rows = self._join_chunks(rows, chunks)
        rows = rows.withColumns({n: combine(F.col(n), F.col(f"_b_{n}")) for n in names})
        return self._extend(rows.drop(*[f"_b_{n}" for n in names]))

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedRows:
        """Add columns worked out from a row's own, such as running ones added before."""
        return self._extend(self.df.withColumns(dict(columns)))

    def add_running(self, sums: Mapping[str, Column]) -> OrderedRows:
        """Add inclusive running sums of the given columns."""
        zero = F.lit(0)
        return self._add_accumulated(sums, F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))

    def add_running_max(self, values: Mapping[str, Column]) -> OrderedRows:
        """Add inclusive running maxima, NULL until the first value."""
        return self._add_accumulated(values, F.max, lambda a, b: F.greatest(a, F.coalesce(b, a)))

    def add_row_number(self, name: str) -> OrderedRows:
        """Add a gapless row number from 1 per key."""
        return self.add_running({name: F.lit(1).cast("bigint")})

    def add_previous(self, value: str, name: str) -> OrderedRows:
        """Add ``value`` of the row before, NULL on a key's first row.

        ``value`` must be the leading order column (that makes a chunk's last
        value its maximum).
        """
        if value != self.order[0]:
            raise ValueError("the previous value is kept for the leading order column")
        chunks = self._totals(True, _last=F.max(value)).select(CHUNK, *self.keys, F.lag("_last").over(self._chunks).alias("_before"))
        rows = self.df.withColumn(name, F.lag(value).over(self._inside))
        rows = self._join_chunks(rows, chunks)
        return self._extend(rows.withColumn(name, F.coalesce(name, "_before")).drop("_before"))

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK, "_spans")


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    return OrderedRows(df, keys, order).add_running(sums).rows()


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return OrderedRows(df, keys, order).add_row_number(name).rows()
