"""Sweep line over marks on a time axis, and joins on the ranks it yields.

Every row puts a few marks on the axis of its key (its start, its end, a probe
into the past). Running totals over all marks in axis order, read back at a
row's own marks, answer "how many / how much before here" for all rows at once,
without a join. Where the neighbours themselves are asked for, the totals give
them as one contiguous rank range, so the join is an equi join on rank blocks
that all hold the same number of rows however bursty the data is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.ordered import with_running

# Exact type for running sums of fractional weights: differences of double
# prefix sums would lose digits on long axes.
WEIGHT = "decimal(30,12)"


class Mark(NamedTuple):
    """One mark per row: where it stands and what it adds to the running totals.

    ``tie`` orders marks at equal ``at`` (0 before, 1 at, 2 after the rows that
    stand there); marks with equal tie follow the row id, then ``sub``.
    """

    name: str
    at: Column
    tie: Column
    sub: int
    adds: Mapping[str, Column]


def sweep(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    marks: Sequence[Mark],
    read: Mapping[str, tuple[str, str]],
    types: Mapping[str, str],
    payload: Sequence[str] = (),
) -> DataFrame:
    """Running totals read at marks: ``read[out] = (mark, total)``; one row per id."""
    kinds = dict(df.dtypes)

    def entry(i: int, m: Mark) -> Column:
        return F.struct(
            F.lit(i).alias("_mark"),
            m.at.cast("bigint").alias("_at"),
            m.tie.cast("int").alias("_tie"),
            F.lit(m.sub).alias("_sub"),
            *[m.adds.get(t, F.lit(0)).cast(k).alias(f"_t_{t}") for t, k in types.items()],
            *[
                (F.col(p) if i == 0 else F.lit(None).cast(kinds[p])).alias(p)
                for p in payload
            ],
        )

    entries = F.array(*[entry(i, m) for i, m in enumerate(marks)])
    on_axis = df.select(*keys, row_id, F.explode(entries).alias("_e")).select(*keys, row_id, "_e.*")
    totals = with_running(
        on_axis, keys, ["_at", "_tie", row_id, "_sub"], {t: F.col(f"_t_{t}") for t in types}
    )
    index = {m.name: i for i, m in enumerate(marks)}
    return totals.groupBy(*keys, row_id).agg(
        *[F.max(p).alias(p) for p in payload],
        *[F.max(F.when(F.col("_mark") == index[m], F.col(t))).alias(out) for out, (m, t) in read.items()],
    )


# A range unfolds to about this many blocks on average, as long as there are so many blocks that every task gets some.
BLOCKS_PER_RANGE = 4
LEAST_BLOCKS = 512


def block_size(ranges: DataFrame, low: str, high: str, least: int = 64, per_range: int = BLOCKS_PER_RANGE) -> int:
    """Ranks in a block, such that ranges unfold to a number of rows that grows with theirs, however long they are (two numbers go to the driver)."""
    asked = ranges.where(F.col(low) <= F.col(high))
    rows, ranks = asked.agg(F.count(F.lit(1)), F.sum((F.col(high) - F.col(low) + 1).cast("double"))).first()
    return max(least, min(int(ranks / rows) // per_range, rows // LEAST_BLOCKS)) if rows else least


def unfold_ranges(ranges: DataFrame, low: str, high: str, block: int) -> DataFrame:
    """A row per range and block of ranks that it touches, ``_block``. Long ranges unfold in two steps to keep each unfolded array short."""
    wide = 1024
    return (
        ranges.where(F.col(low) <= F.col(high))
        .withColumn("_wide", F.explode(F.sequence(F.expr(f"{low} div {block * wide}"), F.expr(f"{high} div {block * wide}"))))
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.greatest(F.expr(f"{low} div {block}"), F.col("_wide") * wide),
                    F.least(F.expr(f"{high} div {block}"), F.col("_wide") * wide + wide - 1),
                )
            ),
        )
        .drop("_wide")
    )


def join_rank_ranges(
    ranges: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    rank: str,
    block: int = 64,
) -> DataFrame:
    """Pair each ``[low, high]`` range with the points whose rank lies in it.

    All blocks hold the same number of points, ``block`` at least, so none can run hot. Longer ranges have larger
    blocks, so what is shuffled grows with the rows and not with the pairs. ``ranges`` are evaluated
    twice, so an expensive input is to be written first.
    """
    block = block_size(ranges, low, high, block)
    return (
        unfold_ranges(ranges, low, high, block)
        .join(points.withColumn("_block", F.expr(f"{rank} div {block}")), [*keys, "_block"])
        .where(F.col(rank).between(F.col(low), F.col(high)))
        .drop("_block")
    )


# Fan-out of the rank tree below.
_FAN = 16


def _tree_depth(df: DataFrame, low: str, high: str) -> int:
    """Levels worth having for the longest range (one number goes to the driver)."""
    longest = df.agg(F.max(F.col(high) - F.col(low) + 1)).first()[0] or 1
    depth = 1
    while _FAN**depth < longest:
        depth += 1
    return depth


def _cover(low: str, high: str, depth: int) -> Column:
    """Tree nodes that together cover ``[low, high]``: at most ``2 * fan`` per level."""
    node = lambda level: lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))
    first = lambda level: F.expr(f"({low} + {_FAN**level - 1}) div {_FAN**level}")
    stop = lambda level: F.expr(f"({high} + 1) div {_FAN**level}")

    def span(a: Column, b: Column) -> Column:
        empty = F.expr("cast(array() as array<bigint>)")
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(empty)

    parts = []
    for level in range(depth):
        a, b = first(level), stop(level)
        if level + 1 == depth:
            nodes = span(a, b)
        else:
            up_a, up_b = first(level + 1) * _FAN, stop(level + 1) * _FAN
            nodes = F.when(up_a < up_b, F.concat(span(a, up_a), span(up_b, b))).otherwise(span(a, b))
        parts.append(F.transform(nodes, node(level)))
    return F.concat(*parts)


def _ancestors(rank: str, depth: int) -> Column:
    return F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.expr(f"{rank} div {_FAN**level}").alias("node"))
            for level in range(depth)
        ]
    )


def range_max(
    rows: DataFrame, keys: Sequence[str], row_id: str, low: str, high: str, rank: str, value: str
) -> DataFrame:
    """Per row: ``max_inside``, the largest value among the ranks in its own range, and
    ``max_covering``, the largest value among the rows whose range holds its rank.

    Both go through a rank tree, so the work per row is a few nodes and does not
    grow with the number of neighbours; node maxima combine map-side.
    """
    keys = list(keys)
    depth = _tree_depth(rows, low, high)
    spot = [*keys, "level", "node"]
    up = rows.select(*keys, row_id, value, F.explode(_ancestors(rank, depth)).alias("_n")).select(
        *keys, row_id, value, "_n.*"
    )
    down = (
        rows.where(F.col(low) <= F.col(high))
        .select(*keys, row_id, value, F.explode(_cover(low, high, depth)).alias("_n"))
        .select(*keys, row_id, value, "_n.*")
    )
    inside = (
        down.select(*spot, row_id)
        .join(up.groupBy(*spot).agg(F.max(value).alias("_m")), spot)
        .select(row_id, F.col("_m").alias("max_inside"), F.lit(None).cast("double").alias("max_covering"))
    )
    covering = (
        up.select(*spot, row_id)
        .join(down.groupBy(*spot).agg(F.max(value).alias("_m")), spot)
        .select(row_id, F.lit(None).cast("double").alias("max_inside"), F.col("_m").alias("max_covering"))
    )
    return (
        inside.unionByName(covering)
        .groupBy(row_id)
        .agg(F.max("max_inside").alias("max_inside"), F.max("max_covering").alias("max_covering"))
    )


# Children of a node in the tree that later_deficits goes through.
_CHILDREN = 8


def later_deficits(rows: DataFrame, keys: Sequence[str], row_id: str, rank: str, reach: str, value: str) -> DataFrame:
    """Per row the sum of ``value - other`` over the rows of later rank whose value is smaller: ``deficit``.

    Divide and conquer over the ranks: two rows part at one level of a tree over the ranks, as different children of one
    node. Per node the rows are ordered by value with a running count and sum per child, and each row reads
    those of the children after its own. No pairs are formed, and a node of any size is ordered in chunks. ``reach`` is how many ranks
    after a row its partners can lie; a level only holds rows with a child border in reach, so levels above the longest reach are thin.
    """
    keys, fan = list(keys), _CHILDREN
    farthest, last = rows.agg(F.max(reach), F.max(rank)).first()
    farthest, last = int(farthest or 0), int(last or 0)
    places, level = [], 0
    while fan**level <= last:
        width = fan**level
        child = F.expr(f"{rank} div {width}")
        digit = child % fan
        asks = (F.expr(f"({rank} + {reach}) div {width}") > child) & (digit < fan - 1)
        told = (F.expr(f"greatest({rank} - {farthest}, 0) div {width}") < child) & (digit > 0)
        place = F.struct(F.lit(level).alias("level"), F.expr(f"{rank} div {width * fan}").alias("node"), digit.cast("int").alias("child"))
        places.append(F.when(asks | told, place))
        level += 1
    if not places:
        return rows.select(row_id, F.lit(0).cast("decimal(38,0)").alias("deficit"))
    held = F.filter(F.array(*places), lambda p: p.isNotNull())
    put = rows.select(*keys, row_id, F.col(value).alias("_value"), F.explode(held).alias("_p")).select(*keys, row_id, "_value", "_p.*")
    sums = {}
    for c in range(1, fan):
        here = F.col("child") == c
        sums |= {f"_n{c}": here.cast("bigint"), f"_s{c}": F.when(here, F.col("_value")).otherwise(0).cast("decimal(20,0)")}
    summed = with_running(put, [*keys, "level", "node"], ["_value", row_id], sums)

    def after(kind: str) -> Column:
        parts = [F.when(F.col("child") < c, F.col(f"_{kind}{c}")).otherwise(0) for c in range(1, fan)]
        total = parts[0].cast("decimal(38,0)")
        for part in parts[1:]:
            total = (total + part).cast("decimal(38,0)")
        return total

    gap = (after("n").cast("decimal(18,0)") * F.col("_value").cast("decimal(19,0)") - after("s")).cast("decimal(38,0)")
    return summed.groupBy(row_id).agg(F.sum(gap).cast("decimal(38,0)").alias("deficit"))
