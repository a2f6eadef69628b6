"""Which queries ran at the same time.

A trace row occupies ``[start_us, start_us + run_us)``. Rows of one key (a
database, by default) are ordered by start, ties by id. An earlier row overlaps
a later one when it has not ended at the later one's start. All times are
integer microseconds, so touching intervals never overlap by rounding.

Counts and sums over neighbours come from a sweep line and never form pairs.
Pairs are formed only where the pairs are the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.sweep import WEIGHT, Mark, block_size, join_rank_ranges, range_max, sweep, unfold_ranges
from querytide.session import staged

KEYS = ("database_id",)


def valid_runs(trace: DataFrame) -> DataFrame:
    """Finished runs without an error."""
    return trace.where((F.col("run_us") > 0) & ~F.col("error"))


def neighbour_sweep(
    trace: DataFrame,
    keys: Sequence[str] = KEYS,
    weights: Mapping[str, Column] | None = None,
    lookback_us: int | None = None,
    payload: Sequence[str] = ("start_us", "run_us"),
    weight_type: str = WEIGHT,
) -> DataFrame:
    """Counts and weight sums over the neighbours of every row, without a join.

    Adds ``rank`` (position by start), ``n_before`` / ``n_after`` (earlier rows
    still running at the start; later rows that start before the end) and, for a
    lookback, ``n_recent`` (rows that ended within it). Each weight ``w`` yields
    ``w_before``, ``w_after`` and ``w_recent`` as exact decimals (whole weights may be
    summed as ``bigint``).
    """
    weights = dict(weights or {})
    start, end = F.col("start_us"), F.col("start_us") + F.col("run_us")
    weighted = trace.withColumns({f"_{w}": F.coalesce(c, F.lit(0)).cast(weight_type) for w, c in weights.items()})
    one = F.lit(1)
    adds = {"n": one, **{w: F.col(f"_{w}") for w in weights}}
    opened = Mark("start", start, F.lit(1), 0, {f"opened_{a}": c for a, c in adds.items()})
    # A run of length zero ends right after its own start, before any later row's.
    ended = Mark(
        "end", end, F.when(F.col("run_us") > 0, 0).otherwise(1), 1, {f"ended_{a}": c for a, c in adds.items()}
    )
    marks = [opened, ended]
    read = {}
    for a in adds:
        read |= {
            f"_{a}_opened": ("start", f"opened_{a}"),
            f"_{a}_ended": ("start", f"ended_{a}"),
            f"_{a}_opened_by_end": ("end", f"opened_{a}"),
        }
    if lookback_us is not None:
        marks.append(Mark("past", start - lookback_us, F.lit(2), 0, {}))
        read |= {f"_{a}_past": ("past", f"ended_{a}") for a in adds}
    types = {
        f"{side}_{a}": "bigint" if a == "n" else weight_type for a in adds for side in ("opened", "ended")
    }
    kept = [*payload, *[f"_{w}" for w in weights]]
    at = sweep(weighted, keys, "query_id", marks, read, types, kept)
    out = {"rank": F.col("_n_opened")}
    for a in adds:
        own = one if a == "n" else F.col(f"_{a}")
        names = ("n_before", "n_after", "n_recent") if a == "n" else (f"{a}_before", f"{a}_after", f"{a}_recent")
        out[names[0]] = F.col(f"_{a}_opened") - own - F.col(f"_{a}_ended")
        out[names[1]] = F.col(f"_{a}_opened_by_end") - F.col(f"_{a}_opened")
        if lookback_us is not None:
            out[names[2]] = F.col(f"_{a}_ended") - F.col(f"_{a}_past")
    return at.select(*keys, "query_id", *payload, *[c.alias(n) for n, c in out.items()])


def concurrency_counts(trace: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of overlapping queries per row."""
    swept = neighbour_sweep(trace, keys, payload=())
    return swept.select("query_id", (F.col("n_before") + F.col("n_after")).alias("n_concurrent"))


def concurrency_by_database(
    trace: DataFrame, min_queries: int = 5000, max_databases: int | None = None
) -> DataFrame:
    """Counts for databases with more than ``min_queries`` rows: all of them, or the
    first ``max_databases`` in id order."""
    chosen = (
        trace.groupBy("database_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > min_queries)
        .select("database_id")
    )
    if max_databases is not None:
        chosen = chosen.orderBy("database_id").limit(max_databases)
    kept = trace.join(chosen, "database_id", "left_semi")
    swept = neighbour_sweep(kept, KEYS, payload=())
    return swept.select("database_id", "query_id", (F.col("n_before") + F.col("n_after")).alias("n_concurrent"))


def ordered_pairs(
    trace: DataFrame,
    keys: Sequence[str] = KEYS,
    columns: Sequence[str] = (),
    max_following: int | None = None,
) -> DataFrame:
    """Every overlapping pair once: ``earlier_*`` and ``later_*`` columns.

    A row's later neighbours are the ranks right after its own, as many as the
    sweep counted. ``max_following`` keeps only that many of them.
    """
    names = ["query_id", *columns]
    ranked = staged(neighbour_sweep(trace, keys, payload=list(columns)), "ranked")
    reach = F.col("n_after")
    if max_following is not None:
        reach = F.least(reach, F.lit(max_following))
    ranges = ranked.select(
        *keys,
        *[F.col(c).alias(f"earlier_{c}") for c in names],
        (F.col("rank") + 1).alias("_low"),
        (F.col("rank") + reach).alias("_high"),
    )
    points = ranked.select(*keys, *[F.col(c).alias(f"later_{c}") for c in names], "rank")
    pairs = join_rank_ranges(ranges, points, keys, "_low", "_high", "rank")
    return pairs.drop("_low", "_high", "rank")


def _turned(pairs: DataFrame, mine: str, theirs: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return pairs.select(
        *keys,
        *[F.col(f"{mine}_{c}").alias(c) for c in columns],
        *[F.col(f"{theirs}_{c}").alias(f"other_{c}") for c in columns],
    )


def predecessors(trace: DataFrame, keys: Sequence[str] = KEYS, columns: Sequence[str] = ()) -> DataFrame:
    """Earlier rows still running at each row's start."""
    return _turned(ordered_pairs(trace, keys, columns), "later", "earlier", keys, ["query_id", *columns])


def successors(
    trace: DataFrame,
    keys: Sequence[str] = KEYS,
    columns: Sequence[str] = (),
    max_following: int | None = None,
) -> DataFrame:
    """Later rows that start before each row's end."""
    pairs = ordered_pairs(trace, keys, columns, max_following)
    return _turned(pairs, "earlier", "later", keys, ["query_id", *columns])


def overlap_pairs(trace: DataFrame, keys: Sequence[str] = KEYS, columns: Sequence[str] = ()) -> DataFrame:
    """Both directions, with ``is_earlier`` telling whether the other row came first.

    The pairs are joined once and each is turned around in place.
    """
    names = ["query_id", *columns]
    pairs = ordered_pairs(trace, keys, columns)

    def side(mine: str, theirs: str, is_earlier: bool) -> Column:
        return F.struct(
            *[F.col(f"{mine}_{c}").alias(c) for c in names],
            *[F.col(f"{theirs}_{c}").alias(f"other_{c}") for c in names],
            F.lit(is_earlier).alias("is_earlier"),
        )

    both = F.array(side("later", "earlier", True), side("earlier", "later", False))
    return pairs.select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.*")


def _ranked_ends(trace: DataFrame, lookback_us: int, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """``rank`` of every row's end on the axis; what ended in the lookback before its start has the ranks ``_past + 1`` to ``_upto``."""
    end = F.col("start_us") + F.col("run_us")
    empty = F.col("run_us") == 0
    marks = [
        Mark("end", end, F.when(empty, 1).otherwise(0), 1, {"n": F.lit(1)}),
        Mark("start", F.col("start_us"), F.lit(1), 0, {}),
        Mark("past", F.col("start_us") - lookback_us, F.lit(2), 0, {}),
    ]
    read = {"rank": ("end", "n"), "_upto": ("start", "n"), "_past": ("past", "n")}
    return sweep(trace, keys, "query_id", marks, read, {"n": "bigint"}, columns)


def recently_finished(
    trace: DataFrame,
    lookback_us: int,
    keys: Sequence[str] = KEYS,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Rows that ended in ``(start - lookback, start]`` of each row.

    Ends are ranked on the axis; the wanted ones are a contiguous rank range.
    """
    names = ["query_id", *columns]
    ranked = staged(_ranked_ends(trace, lookback_us, keys, columns), "ends")
    ranges = ranked.select(*keys, *names, (F.col("_past") + 1).alias("_low"), F.col("_upto").alias("_high"))
    points = ranked.select(*keys, *[F.col(c).alias(f"other_{c}") for c in names], "rank")
    pairs = join_rank_ranges(ranges, points, keys, "_low", "_high", "rank")
    return pairs.drop("_low", "_high", "rank")


_LATER, _EARLIER, _RECENT = range(3)


def _slice_of(side: int, low: str, high: str) -> Column:
    """The points of a block's list whose ranks lie in a row's range: a slice where no rank is missing."""
    points, ranks, first, last = (F.col(f"_{c}{side}") for c in ("points", "ranks", "first", "last"))
    start, stop = F.greatest(F.col(low), first), F.least(F.col(high), last)
    sliced = F.slice(points, (start - first + 1).cast("int"), F.greatest(stop - start + 1, F.lit(0)).cast("int"))
    searched = F.filter(points, lambda _, i: F.get(ranks, i).between(F.col(low), F.col(high)))
    return F.when((F.col(low) <= F.col(high)) & first.isNotNull(), F.when(ranks.isNull(), sliced).otherwise(searched))


def neighbour_lists(
    runs: DataFrame,
    point: Column,
    keys: Sequence[str] = KEYS,
    lookback_us: int | None = None,
    max_following: int | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """One row per ``query_id`` with the lists of its neighbours, ``point`` of each: ``later``, ``earlier`` and, for a lookback, ``recent``.

    ``own`` holds the rows of ``runs`` with that id (one, unless ids repeat). A run without neighbours has empty lists; their order is
    left open. Pairs are never shuffled: the runs are cut into blocks of ranks, each block gets the rows that any of its runs meets,
    once, and a run takes its lists from those of its block. So what is moved grows with the rows, and the lists exist only while
    their row passes; keep them out of shuffles. ``point`` may read ``query_id``, ``query_idx``, ``start_us``, ``run_us`` and ``columns``.
    """
    keys, columns = list(keys), ["query_idx", "start_us", "run_us", *columns]
    reach = F.col("n_after") if max_following is None else F.least("n_after", F.lit(max_following))
    swept = neighbour_sweep(runs, keys, payload=columns).withColumn("_high", F.col("rank") + reach)
    ranked = staged(swept.select(*keys, "query_id", "rank", (F.col("rank") + 1).alias("_low"), "_high", point.alias("_point")), "ranked")
    block = block_size(ranked, "_low", "_high", per_range=1)
    placed = ranked.withColumn("_block", F.expr(f"rank div {block}"))

    def of_blocks(placed: DataFrame, points: DataFrame, low: str, high: str, side: int) -> DataFrame:
        """What any row of a block has in its range, once per block."""
        spans = placed.where(F.col(low) <= F.col(high)).groupBy(*keys, "_block").agg(F.min(low).alias("_from"), F.max(high).alias("_to"))
        spans = spans.withColumnRenamed("_block", "_of")
        met = join_rank_ranges(spans, points.select(*keys, "rank", "_point"), keys, "_from", "_to", "rank")
        return met.select(*keys, F.col("_of").alias("_block"), F.lit(side).alias("_side"), "rank", F.lit(None).cast("bigint").alias("_high"), "_point")

    covering = unfold_ranges(ranked, "_low", "_high", block)
    covering = covering.select(*keys, "_block", F.lit(_EARLIER).alias("_side"), "rank", "_high", "_point")
    pools, sides = of_blocks(placed, ranked, "_low", "_high", _LATER).unionByName(covering), [_LATER]
    asks = placed.select(*keys, "query_id", "_block", "rank", "_low", "_high")
    if lookback_us is not None:
        ends = _ranked_ends(runs, lookback_us, keys, columns)
        ends = staged(ends.select(*keys, "query_id", "rank", (F.col("_past") + 1).alias("_since"), "_upto", point.alias("_point")), "ends")
        asks = asks.join(ends.select(*keys, "query_id", "_since", "_upto"), [*keys, "query_id"])
        asks = staged(asks, "asked")
        pools, sides = pools.unionByName(of_blocks(asks, ends, "_since", "_upto", _RECENT)), [_LATER, _RECENT]

    pools = pools.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.when(F.col("_side") == _EARLIER, F.struct("rank", "_high", "_point")))).alias("_covering"),
        *[F.sort_array(F.collect_list(F.when(F.col("_side") == k, F.struct("rank", "_point")))).alias(f"_rows{k}") for k in sides],
    )
    for k in sides:
        rows, first, last = F.col(f"_rows{k}"), F.col(f"_first{k}"), F.col(f"_last{k}")
        pools = pools.withColumns({f"_first{k}": F.get(rows, F.lit(0))["rank"], f"_last{k}": F.get(rows, F.size(rows) - 1)["rank"]})
        gaps = F.size(rows) != last - first + 1
        pools = pools.withColumns({f"_points{k}": rows["_point"], f"_ranks{k}": F.when(gaps, rows["rank"])}).drop(f"_rows{k}")

    # The runs join their place before they get lists, so lists needn't be moved.
    repeated = runs.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("query_id")
    own = runs.select("query_id", F.struct(*runs.columns).alias("_own"))
    hidden = {k: f"_key_{k}" for k in keys}
    asks, pools = asks.withColumnsRenamed(hidden), pools.withColumnsRenamed(hidden)
    empty = F.slice(F.array(point), 1, 0)
    kind = runs.select(empty.alias("e")).schema["e"].dataType

    def listed(rows: DataFrame) -> DataFrame:
        met = rows.join(pools, [*hidden.values(), "_block"], "left")
        earlier = F.filter("_covering", lambda e: (e["rank"] < F.col("rank")) & (e["_high"] >= F.col("rank")))["_point"]
        lists = {"later": _slice_of(_LATER, "_low", "_high"), "earlier": earlier}
        if lookback_us is not None:
            lists["recent"] = _slice_of(_RECENT, "_since", "_upto")
        return met.select("query_id", "_own", *[F.coalesce(c, F.array().cast(kind)).alias(n) for n, c in lists.items()])

    if repeated.isEmpty():
        return listed(own.join(asks, "query_id", "left")).withColumn("own", F.array("_own")).drop("_own")
    single = listed(own.join(repeated, "query_id", "left_anti").join(asks, "query_id", "left")).withColumn("own", F.array("_own")).drop("_own")
    names = [c for c in single.columns if c not in ("query_id", "own")]
    # Ids that repeat, perhaps under several keys, have all their rows and lists in one.
    several = listed(asks.join(repeated, "query_id", "left_semi").withColumn("_own", F.lit(None).cast(own.schema["_own"].dataType)))
    several = several.groupBy("query_id").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in names])
    owners = own.join(repeated, "query_id", "left_semi").groupBy("query_id").agg(F.collect_list("_own").alias("own"))
    several = owners.join(several, "query_id", "left").withColumns({n: F.coalesce(n, F.array().cast(kind)) for n in names})
    return single.unionByName(several)


def concurrency_dataset(
    trace: DataFrame,
    lookback_us: int | None = None,
    engine: str | None = None,
    keys: Sequence[str] = KEYS,
    max_following: int | None = None,
) -> DataFrame:
    """One row per valid run with its neighbour lists and their sizes.

    Other columns of the trace stay with their row, and an engine filter holds
    for the neighbours too. Lists are sorted by start; a run without neighbours
    has empty lists. Use the counts of ``neighbour_sweep`` where lists are not needed.
    """
    runs = valid_runs(trace)
    if engine is not None:
        runs = runs.where(F.col("engine") == engine)
    end = F.col("start_us") + F.col("run_us")
    neighbour = F.struct("start_us", end.alias("end_us"), "query_idx", "query_id")
    lists = neighbour_lists(runs, neighbour, keys, lookback_us, max_following)
    infos = {"concur_info": F.sort_array(F.concat("earlier", "later")), "concur_info_train": F.sort_array("earlier")}
    if lookback_us is not None:
        infos["pre_exec_info"] = F.sort_array("recent")
    result = lists.select("query_id", F.explode("own").alias("_own"), *[c for c in lists.columns if c not in ("own", "query_id")])
    others = [F.col("_own")[c].alias(c) for c in runs.columns if c != "query_id"]
    result = result.select("query_id", *others, *[c.alias(n) for n, c in infos.items()])
    return result.withColumns(
        {
            "end_us": F.col("start_us") + F.col("run_us"),
            "num_concurrent_queries": F.size("concur_info"),
            "num_concurrent_queries_train": F.size("concur_info_train"),
        }
    )


def max_over_neighbours(swept: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest ``value`` among earlier and among later neighbours, NULL when none.

    ``swept`` is the result of ``neighbour_sweep`` with ``value`` as payload. Later
    neighbours are a rank range; earlier ones are the rows whose range holds this
    row's rank. Neither needs the pairs.
    """
    placed = swept.select(
        *keys,
        "query_id",
        F.col(value).cast("double").alias("_value"),
        "rank",
        (F.col("rank") + 1).alias("_low"),
        (F.col("rank") + F.col("n_after")).alias("_high"),
    )
    return range_max(placed, keys, "query_id", "_low", "_high", "rank", "_value").select(
        "query_id",
        F.col("max_covering").alias("max_before"),
        F.col("max_inside").alias("max_after"),
    )


def neighbour_max(trace: DataFrame, value: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """``max_over_neighbours`` of a trace."""
    swept = neighbour_sweep(trace.withColumn("_value", value.cast("double")), keys, payload=["_value"])
    return max_over_neighbours(staged(swept, "ranked"), "_value", keys)
