"""How much the neighbours of a run get in its way: IO, CPU and memory figures and scores.

All sums over neighbours are sweep-line sums, all maxima go through a rank tree, and the time
that is shared with later neighbours is a sweep-line sum less what neighbours that end first leave
out, which goes through a rank tree too. No pairs are formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.sweep import later_deficits
from querytide.operators.overlap import KEYS, max_over_neighbours, neighbour_sweep
from querytide.operators.shaping import MICROS
from querytide.session import staged

MB = 1024 * 1024


def query_profiles(
    isolated: DataFrame, averages: DataFrame, cards: DataFrame, scans: DataFrame
) -> DataFrame:
    """One row per query that all sources know: runtimes (s), scan (MB), cardinalities (mega units).

    ``cards`` is ``(query_idx, card)`` per plan node, ``scans`` is
    ``(query_idx, table_name, scan_mb)``.
    """
    plan = cards.groupBy("query_idx").agg(
        (F.max("card") / MB).alias("max_card"),
        (F.sum("card") / MB).alias("sum_card"),
        F.count("card").alias("n_card"),
    )
    scanned = scans.groupBy("query_idx").agg(F.sum("scan_mb").alias("scan_mb"))
    joined = averages.join(isolated, "query_idx", "left").join(plan, "query_idx", "left").join(scanned, "query_idx", "left")
    return joined.select(
        "query_idx",
        (F.col("isolated_us") / MICROS).alias("isolated_s"),
        (F.col("average_us") / MICROS).alias("average_s"),
        "scan_mb",
        "max_card",
        "sum_card",
        "n_card",
    )


def data_sharing(
    runs: DataFrame,
    scans: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = KEYS,
    prior_only: bool = False,
    lookback_us: int | None = None,
) -> DataFrame:
    """Share of each run's scan that its neighbours (and just finished ones) scan too.

    Per table the neighbours' scanned fractions add up along the sweep, without pairs. Tables that the same queries scan
    are a class: neighbours are counted per class and scanning query, and the share follows from these counts, once for
    all runs with the same ones. Runs are unfolded to the tables themselves where a class has no more tables than scanning queries.
    """
    fraction = F.when(F.col("size_mb") > 0, F.col("scan_mb") / F.col("size_mb"))
    tables = scans.join(sizes.select(F.col("relname").alias("table_name"), "size_mb"), "table_name").select(
        "query_idx", "table_name", "scan_mb", fraction.alias("_fraction")
    )
    tables = staged(_classed(tables), "classed")
    runs = staged(runs.select(*keys, "query_id", "query_idx", "start_us", "run_us"), "runs")
    parts = _shares_by_class(runs, tables.where("_counted"), keys, prior_only, lookback_us)
    alone = tables.where("NOT _counted")
    if not alone.isEmpty():
        parts = parts.unionByName(_shares_by_table(runs, alone, keys, prior_only, lookback_us))
    total = F.sum("_own")
    return parts.groupBy("query_id").agg(
        F.coalesce(F.least(F.sum("_shared") / F.when(total > 0, total), F.lit(1.0)), F.lit(0.0)).alias("sharing")
    )


# Fractions below this, times counts of neighbours below it, stay exact in 38 digits.
_MOST = 10**12


def _classed(tables: DataFrame) -> DataFrame:
    """Adds ``_scanners``, the sorted queries that scan a table, ``_class``, the first table that the same ones scan,
    and ``_counted``, whether counts of neighbours are fewer than the tables of the class.

    Counts need one row per query and table, and fractions from 0 on.
    """
    plain = F.coalesce(F.col("_fraction").between(0, _MOST - 1), F.lit(True))
    scanners = tables.groupBy("table_name").agg(
        F.array_sort(F.collect_set("query_idx")).alias("_scanners"), F.count(F.lit(1)).alias("_rows"), F.min(plain).alias("_plain")
    )
    scanners = scanners.withColumn("_plain", F.col("_plain") & (F.col("_rows") == F.size("_scanners")))
    classes = scanners.where("_plain").groupBy("_scanners").agg(F.min("table_name").alias("_class"), F.count(F.lit(1)).alias("_tables"))
    counted = F.col("_plain") & ((F.size("_scanners") == 1) | (F.col("_tables") > F.size("_scanners")))
    known = scanners.join(classes, "_scanners", "left").select("table_name", "_scanners", "_class", counted.alias("_counted"))
    return tables.join(known, "table_name")


def _shares_by_table(
    runs: DataFrame, tables: DataFrame, keys: Sequence[str], prior_only: bool, lookback_us: int | None
) -> DataFrame:
    """``_shared`` and ``_own`` MB of every run and table it scans."""
    unfolded = staged(runs.join(tables.drop("_scanners", "_class", "_counted"), "query_idx"), "unfolded")
    swept = neighbour_sweep(
        unfolded, [*keys, "table_name"], {"part": F.col("_fraction")}, lookback_us, payload=["scan_mb"]
    )
    others = _double(*_sides("part", prior_only, lookback_us))
    own = F.col("scan_mb")
    return swept.select("query_id", F.least(others * own, own).alias("_shared"), own.alias("_own"))


def _shares_by_class(
    runs: DataFrame, tables: DataFrame, keys: Sequence[str], prior_only: bool, lookback_us: int | None
) -> DataFrame:
    """``_shared`` and ``_own`` MB of every run and class of tables it scans."""
    scanned = tables.where("table_name = _class").select("query_idx", "_class", F.explode("_scanners").alias("_scanner"))
    unfolded = scanned.withColumn("_same", (F.col("_scanner") == F.col("query_idx")).cast("bigint"))
    unfolded = staged(runs.join(unfolded, "query_idx"), "unfolded")
    swept = neighbour_sweep(
        unfolded, [*keys, "_class", "_scanner"], {"same": F.col("_same")}, lookback_us, payload=["query_idx"], weight_type="bigint"
    )
    count = sum((F.col(c) for c in _sides("same", prior_only, lookback_us)), F.lit(0))
    counts = swept.groupBy(*keys, "query_id", "query_idx", "_class").agg(
        F.array_sort(F.collect_list(F.struct("_scanner", count.alias("n")))).alias("_counts")
    )
    counts = staged(counts.select("query_id", "query_idx", "_class", F.transform("_counts", lambda c: c["n"]).alias("_counts")), "counts")
    # Fractions of a table in the order of its class, with twelve decimals as in sums of weights.
    weight = F.coalesce("_fraction", F.lit(0)).cast("decimal(24,12)")
    fractions = tables.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("query_idx", weight.alias("f")))).alias("_f"))
    fractions = fractions.select("table_name", F.transform("_f", lambda f: f["f"]).alias("_f"))
    known = tables.select("query_idx", "table_name", "scan_mb", "_class").join(fractions, "table_name")
    spot = ["query_idx", "_class", "_counts"]
    cases = counts.select(*spot).distinct().join(known, ["query_idx", "_class"])
    weighted = F.zip_with("_counts", "_f", lambda n, f: n.cast("decimal(12,0)") * f)
    others = F.aggregate(weighted, F.lit(0).cast("decimal(37,12)"), lambda a, x: (a + x).cast("decimal(37,12)")).cast("double")
    own = F.col("scan_mb")
    shares = cases.groupBy(*spot).agg(F.sum(F.least(others * own, own)).alias("_shared"), F.sum(own).alias("_own"))
    return counts.join(shares, spot).select("query_id", "_shared", "_own")


def _sides(name: str, prior_only: bool, lookback_us: int | None) -> list[str]:
    """Columns of a swept weight that neighbours, and just finished ones, add up in."""
    sides = ["before"] + ["after"] * (not prior_only) + ["recent"] * (lookback_us is not None)
    return [f"{name}_{side}" for side in sides]


def _swept(runs: DataFrame, profiles: DataFrame, keys: Sequence[str], overlaps: bool = False) -> DataFrame:
    # Written once: the sweep reads its input twice (to find chunk borders, and to shuffle).
    known = staged(
        runs.select(*keys, "query_id", "query_idx", "start_us", "run_us").join(profiles, "query_idx", "left"), "known"
    )
    weights = {
        "rt": F.col("average_s"),
        "scan": F.col("scan_mb"),
        "card": F.col("sum_card") * MB,
        "cards": F.col("n_card"),
        "start": F.col("start_us"),
    }
    payload = ["query_idx", "start_us", "run_us", "max_card"]
    swept = staged(neighbour_sweep(known, keys, weights, payload=payload).withColumn("_end_us", F.col("start_us") + F.col("run_us")), "swept")
    peaks = max_over_neighbours(swept, "max_card", keys)
    swept = swept.drop("max_card")
    # Runs without an own profile serve as neighbours only.
    own = profiles.where(F.col("isolated_s").isNotNull() & F.col("scan_mb").isNotNull() & F.col("n_card").isNotNull())
    busy = swept.where(F.col("n_before") + F.col("n_after") > 0)
    if overlaps:
        deficits = later_deficits(swept.drop("max_card"), keys, "query_id", "rank", "n_after", "_end_us")
        busy = busy.join(deficits, "query_id", "left")
    return busy.join(own, "query_idx").join(peaks, "query_id", "left")


def _double(*names: str) -> Column:
    total = F.col(names[0]).cast("double")
    for name in names[1:]:
        total = total + F.col(name).cast("double")
    return total


def _mean_card(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count / MB).otherwise(0.0)


CONTENTION_COLUMNS = (
    "isolated_s", "average_s", "n", "sum_neighbour_s", "scan_mb", "neighbour_scan_mb", "sharing",
    "max_card", "avg_card", "neighbour_max_card", "neighbour_avg_card",
)


def contention_features(
    runs: DataFrame,
    profiles: DataFrame,
    scans: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = KEYS,
    prior_only: bool = False,
    lookback_us: int | None = None,
) -> DataFrame:
    """``CONTENTION_COLUMNS`` for every run that had neighbours and has a profile."""
    sides = ("before",) if prior_only else ("before", "after")
    over = lambda name: _double(*[f"{name}_{s}" for s in sides])
    peak = F.greatest(*[F.coalesce(f"max_{s}", F.lit(0.0)) for s in ("before", "after")])
    if prior_only:
        peak = F.coalesce("max_before", F.lit(0.0))
    shared = data_sharing(runs, scans, sizes, keys, prior_only, lookback_us)
    rows = _swept(runs, profiles, keys).join(shared, "query_id", "left")
    return rows.select(
        "query_id",
        "query_idx",
        (F.col("run_us") / MICROS).alias("label_s"),
        "isolated_s",
        "average_s",
        over("n").alias("n"),
        over("rt").alias("sum_neighbour_s"),
        "scan_mb",
        over("scan").alias("neighbour_scan_mb"),
        F.coalesce("sharing", F.lit(0.0)).alias("sharing"),
        "max_card",
        (F.col("sum_card") / F.col("n_card")).alias("avg_card"),
        peak.alias("neighbour_max_card"),
        _mean_card(over("card"), over("cards")).alias("neighbour_avg_card"),
    )


SPLIT_COLUMNS = (
    "isolated_s", "average_s", "n_pre", "n_post", "sum_s_pre", "sum_s_post", "avg_elapsed_pre",
    "sum_overlap_post", "scan_mb", "scan_pre", "scan_post", "sharing", "max_card", "avg_card",
    "max_card_pre", "max_card_post", "avg_card_pre", "avg_card_post",
)


def contention_features_split(
    runs: DataFrame,
    profiles: DataFrame,
    scans: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = KEYS,
    prior_only: bool = False,
    lookback_us: int | None = None,
) -> DataFrame:
    """``SPLIT_COLUMNS``: earlier and later neighbours apart.

    The overlap with a later neighbour ends with whichever of the two ends first.
    With ``prior_only`` nothing is known of later neighbours and their columns are 0.
    """
    shared = data_sharing(runs, scans, sizes, keys, True, lookback_us)
    rows = _swept(runs, profiles, keys, not prior_only).join(shared, "query_id", "left")
    zero = F.lit(0.0)
    later = lambda value: zero if prior_only else value
    if prior_only:
        rows = rows.withColumn("_overlap_us", F.lit(None).cast("double"))
    else:
        # As if every later neighbour outlasted this run, less what those that end first leave of it.
        longest = F.col("n_after") * F.col("_end_us") - F.col("start_after")
        rows = rows.withColumn("_overlap_us", (longest - F.coalesce("deficit", F.lit(0))).cast("double"))
    elapsed = (F.col("n_before") * F.col("start_us") - F.col("start_before")).cast("double") / MICROS
    return rows.select(
        "query_id",
        "query_idx",
        (F.col("run_us") / MICROS).alias("label_s"),
        "isolated_s",
        "average_s",
        _double("n_before").alias("n_pre"),
        later(_double("n_after")).alias("n_post"),
        _double("rt_before").alias("sum_s_pre"),
        later(_double("rt_after")).alias("sum_s_post"),
        (elapsed / (F.col("n_before") + 0.001)).alias("avg_elapsed_pre"),
        later(F.coalesce(F.col("_overlap_us") / MICROS, zero)).alias("sum_overlap_post"),
        "scan_mb",
        _double("scan_before").alias("scan_pre"),
        later(_double("scan_after")).alias("scan_post"),
        F.coalesce("sharing", zero).alias("sharing"),
        "max_card",
        (F.col("sum_card") / F.col("n_card")).alias("avg_card"),
        F.coalesce("max_before", zero).alias("max_card_pre"),
        later(F.coalesce("max_after", zero)).alias("max_card_post"),
        _mean_card(_double("card_before"), _double("cards_before")).alias("avg_card_pre"),
        later(_mean_card(_double("card_after"), _double("cards_after"))).alias("avg_card_post"),
    )


# Starting parameters of the two scoring formulas.
SCORE_PARAMETERS = {
    "q1": 0.5, "i1": 20, "i2": 2, "c1": 0.2, "m1": 0.5, "m2": 0.5, "m3": 0.1, "cm1": 0.2,
    "r1": 0.8, "r2": 0.2, "max_concurrency": 10, "avg_io_speed": 200, "memory_size": 16000,
}
SPLIT_PARAMETERS = {
    "n1": 0.3, "q1": 0.5, "i1": 20, "i2": 2, "c1": 0.2, "c2": 0.9, "m1": 0.3, "m2": 0.3, "m3": 0.3, "m4": 0.3,
    "m5": 0.1, "cm1": 0.2, "r1": 0.5, "r2": 0.5, "max_concurrency": 10, "avg_io_speed": 200, "memory_size": 16000,
}


def _at_least(value: Column, bound: float) -> Column:
    return F.greatest(value, F.lit(float(bound)))


def _io_speed(busy: Column, p: Mapping[str, float]) -> Column:
    """Base speed plus this run's part of the shared bandwidth."""
    return p["i1"] + p["avg_io_speed"] / F.least(_at_least(busy, 1), F.lit(float(p["max_concurrency"])))


def _pressure(own: Column, other: Column, share: Column, p: Mapping[str, float], scale: float = 1.0, floor: float = 0.01) -> Column:
    """Memory beyond what there is, weighted by one side's share of it."""
    return _at_least(scale * (own + other) - p["memory_size"], floor) * share


def contention_score(parameters: Mapping[str, float] | None = None) -> Column:
    """Expected runtime (s) from ``CONTENTION_COLUMNS``: queueing + IO + CPU under contention."""
    p = {**SCORE_PARAMETERS, **(parameters or {})}
    n, others, average = F.col("n"), F.col("sum_neighbour_s"), F.col("average_s")
    top, mean = F.col("max_card"), F.col("avg_card")
    top_near, mean_near = F.col("neighbour_max_card"), F.col("neighbour_avg_card")
    limit, some = F.lit(float(p["max_concurrency"])), _at_least(n, 1)
    waiting = p["q1"] * _at_least(n - limit, 0) / some * others
    io = p["i2"] * F.col("scan_mb") * (1 - F.col("sharing")) / _io_speed(n, p)
    alone = p["r1"] * F.col("isolated_s") + p["r2"] * average - io
    cpu = F.least(n, limit) / some * others / average
    load = F.log(
        p["m1"] * _pressure(top, top_near, _share(top_near, top), p)
        + p["m2"] * _pressure(mean, mean_near, _share(mean_near, mean), p)
        + 0.0001
    ) * F.log(p["m1"] * top + p["m2"] * mean + 0.0001)
    memory = _at_least(load, 0)
    slowdown = 1 + p["c1"] * cpu + p["m3"] * memory + p["cm1"] * F.sqrt(cpu * memory)
    return _at_least(waiting + io + slowdown * alone, 0.01)


def _share(part: Column, rest: Column) -> Column:
    """``part`` of the sum of both; 0 where the sum is 0."""
    whole = part + rest
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part, whole))


def _split_parts(p: Mapping[str, float], least_left: float) -> dict[str, Column]:
    """What both split formulas share: running fraction, queueing and IO speed."""
    pre, post = F.col("n_pre"), F.col("n_post")
    limit = F.lit(float(p["max_concurrency"]))
    running = F.least(pre + post, limit) / _at_least(pre + post, 1)
    left = F.col("sum_s_pre") - F.col("avg_elapsed_pre") * pre
    near = pre + p["n1"] * post
    waiting = p["q1"] * _at_least(near - limit, 0) / _at_least(near, 1) * (left + p["n1"] * F.col("sum_s_post"))
    left_share = _at_least(left * running / _at_least(F.col("sum_s_pre"), 0.1), least_left)
    post_share = F.col("sum_overlap_post") / _at_least(F.col("sum_s_post"), 0.1)
    return {
        "running": running,
        "waiting": _at_least(waiting, 0),
        "left_share": left_share,
        "speed": _io_speed(pre * left_share + p["n1"] * post * post_share, p),
    }


def _split_memory(level: str, p: Mapping[str, float], scale: float, floor: float) -> Column:
    """Own share of the pressure with earlier and with later neighbours, relative to the memory."""
    own = F.col(f"{level}_card")
    sides = [F.col(f"{level}_card_{side}") for side in ("pre", "post")]
    first, second = (_pressure(own, near, _share(own, near), p, scale, floor) for near in sides)
    return (first + second) / p["memory_size"]


def contention_score_split(parameters: Mapping[str, float] | None = None) -> Column:
    """Expected runtime (s) from ``SPLIT_COLUMNS``."""
    p = {**SPLIT_PARAMETERS, **(parameters or {})}
    part = _split_parts(p, 0)
    average = F.col("average_s")
    io = p["i2"] * F.col("scan_mb") * (1 - F.col("sharing") * part["running"]) / part["speed"]
    alone = _at_least(p["r1"] * F.col("isolated_s") + p["r2"] * average - io, 0.1)
    cpu_pre = F.col("sum_s_pre") * part["left_share"] / average
    cpu_post = F.col("sum_overlap_post") / average
    memory = p["m3"] * p["m1"] * _split_memory("max", p, 1, 0.01) + p["m4"] * p["m2"] * _split_memory("avg", p, 1, 0.01)
    slowdown = p["c1"] * (cpu_pre + p["c2"] * cpu_post) * (
        1 + p["m5"] * memory + p["cm1"] * F.sqrt((cpu_pre + cpu_post) * memory)
    )
    return _at_least(part["waiting"] + io + (1 + slowdown) * alone, 0.01)


def contention_score_split_v2(parameters: Mapping[str, float] | None = None) -> Column:
    """The variant with unshared IO in the CPU part and rooted memory pressure."""
    p = {**SPLIT_PARAMETERS, **(parameters or {})}
    part = _split_parts(p, 0.1)
    average, usual = F.col("average_s"), _at_least(F.col("average_s"), 2)
    unshared = p["i2"] * F.col("scan_mb") / part["speed"]
    io = unshared * _at_least(1 - F.col("sharing") * part["running"], 0)
    alone = _at_least(p["r1"] * F.col("isolated_s") + (1 - p["r1"]) * average - unshared, 0.1)
    cpu_pre = F.col("sum_s_pre") * part["left_share"] / usual
    cpu_post = F.col("sum_overlap_post") / usual
    memory = p["m3"] * F.sqrt(_split_memory("max", p, p["m1"], 0)) + p["m4"] * F.sqrt(_split_memory("avg", p, p["m2"], 0))
    slowdown = p["c1"] * (cpu_pre + p["c2"] * cpu_post) * (1 + memory + p["cm1"] * F.sqrt((cpu_pre + cpu_post) * memory))
    return _at_least(part["waiting"] + io + (1 + slowdown) * alone, 0.01)
