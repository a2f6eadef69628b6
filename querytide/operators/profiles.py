"""Concurrency and load profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.functions.quantiles import exact_percentiles
from querytide.operators.overlap import KEYS, neighbour_sweep
from querytide.operators.shaping import MICROS, on_day_type

DAY_S = 86_400


def _label(second: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(two(F.floor(second / 3600)), F.lit(":"), two(F.floor(F.pmod(second, F.lit(3600)) / 60)), F.lit(":00"))


def _grid(base: DataFrame, step_s: int) -> DataFrame:
    """Every row of ``base`` with every bucket of a day."""
    seconds = F.sequence(F.lit(0), F.lit(DAY_S - step_s), F.lit(step_s))
    return base.withColumn("bucket_s", F.explode(seconds))


def _filled(grid: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    zero = F.lit(0)
    return grid.join(found, list(on), "left").select(
        *on,
        F.coalesce("n_queries", zero).cast("bigint").alias("n_queries"),
        F.coalesce("mean_concurrent", F.lit(0.0)).alias("mean_concurrent"),
    )


def interval_profile(
    log: DataFrame,
    minutes: int = 10,
    day_type: str = "all",
    dates: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Queries and their mean concurrency per date and time-of-day bucket, per key.

    ``log`` has ``query_id, created_time, run_us``. Neighbours are counted within
    a date, as the profile of a day stands for itself. Buckets carry the label of
    their start; buckets without queries are 0.
    """
    on = [*keys, "date"]
    rows = on_day_type(log, day_type, dates).select(
        *keys,
        "query_id",
        "run_us",
        F.to_date("created_time").alias("date"),
        F.unix_micros(F.col("created_time").cast("timestamp")).alias("start_us"),
    )
    swept = neighbour_sweep(rows, on, payload=["start_us"])
    second = F.floor(F.col("start_us") / MICROS) % DAY_S
    step = minutes * 60
    found = (
        swept.withColumn("bucket_s", (second - second % step).cast("int"))
        .groupBy(*on, "bucket_s")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.avg(F.col("n_before") + F.col("n_after")).alias("mean_concurrent"),
        )
    )
    if dates is not None:
        days = on_day_type(dates, day_type, at="date").select("date").distinct()
    else:
        # One row per key; every day between the first and the last one seen is unfolded.
        found_keys = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        first, last = rows.agg(F.min("date")).scalar(), rows.agg(F.max("date")).scalar()
        days = found_keys.select(*keys, F.explode(F.sequence(first, last)).alias("date"))
        days = on_day_type(days, day_type, at="date")
    profile = _filled(_grid(days, step), found, [*on, "bucket_s"])
    return profile.withColumn("bucket", _label(F.col("bucket_s")))


def average_days(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average of an interval profile over its dates; empty days count as 0."""
    return profile.groupBy(*keys, "bucket").agg(
        F.avg("n_queries").alias("n_queries"), F.avg("mean_concurrent").alias("mean_concurrent")
    )


def average_databases(
    log: DataFrame, min_queries: int = 5000, max_databases: int | None = None, minutes: int = 10, day_type: str = "all"
) -> DataFrame:
    """Average of the day profiles of the larger databases."""
    chosen = (
        log.groupBy("database_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > min_queries)
        .select("database_id")
    )
    if max_databases is not None:
        chosen = chosen.orderBy("database_id").limit(max_databases)
    kept = log.join(chosen, "database_id", "left_semi")
    per_database = average_days(interval_profile(kept, minutes, day_type, keys=KEYS), KEYS)
    return average_days(per_database)


def single_day_profile(trace: DataFrame, minutes: int = 10) -> DataFrame:
    """The profile of one 24 h run, on time since its start."""
    step = minutes * 60
    swept = neighbour_sweep(trace, (), payload=["start_us"])
    second = F.floor(F.col("start_us") / MICROS)
    found = (
        swept.where(second.between(0, DAY_S - 1))
        .withColumn("bucket_s", (second - second % step).cast("int"))
        .groupBy("bucket_s")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.avg(F.col("n_before") + F.col("n_after")).alias("mean_concurrent"),
        )
    )
    grid = _grid(trace.sparkSession.range(1), step).drop("id")
    return _filled(grid, found, ["bucket_s"]).withColumn("bucket", _label(F.col("bucket_s")))


def runtime_histogram(trace: DataFrame, max_us: int, bins: int = 100) -> DataFrame:
    """Equal bins over the runtimes below a cap; the last bin includes its upper edge."""
    kept = trace.where(F.col("run_us") < max_us)
    low, high = kept.agg(F.min("run_us")).scalar(), kept.agg(F.max("run_us")).scalar()
    # As elsewhere, one shared value gets a bin range of width one around it.
    width = F.greatest(high - low, F.lit(1))
    spot = F.floor((F.col("run_us") - low) * bins / width)
    counted = kept.groupBy(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = trace.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda number: (low + number * (high - low) / bins) / MICROS
    return grid.join(counted, "bin", "left").select(
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        edge(F.col("bin")).alias("low_s"),
        edge(F.col("bin") + 1).alias("high_s"),
    )


def runtime_summary(trace: DataFrame) -> DataFrame:
    median = exact_percentiles(trace, [], "run_us", {"median": 0.5})
    return trace.agg(
        F.min("run_us").alias("min_us"), F.max("run_us").alias("max_us"), F.avg("run_us").alias("mean_us")
    ).withColumn("median_us", median.scalar())


def running_load(trace: DataFrame, estimate: Column, threshold: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """At each arrival the estimated load of the queries in flight, and whether this one still fits."""
    rows = trace.withColumn("_own", estimate.cast("double"))
    swept = neighbour_sweep(rows, keys, {"load": F.col("_own")}, payload=["_own"])
    load = F.col("load_before").cast("double")
    return swept.select(
        *keys, "query_id", load.alias("load"), (load + F.col("_own") <= threshold).alias("fits")
    )


def starvation_top_k(waiting: DataFrame, step_us: int, penalty: float, k: int) -> DataFrame:
    """At every ``step_us`` the ``k`` waiting queries with the highest ``wait * penalty + estimate``.

    ``waiting`` has ``query_id, enter_us, leave_us, estimate``. The rank filter
    keeps ``k`` rows per snapshot and task before the shuffle.
    """
    first = F.ceil(F.col("enter_us") / step_us)
    last = F.ceil(F.col("leave_us") / step_us) - 1
    seen = (
        waiting.where(first <= last)
        .withColumn("_step", F.explode(F.sequence(first, last)))
        .withColumn("snapshot_us", F.col("_step") * step_us)
    )
    score = (F.col("snapshot_us") - F.col("enter_us")) / MICROS * penalty + F.col("estimate")
    best = Window.partitionBy("snapshot_us").orderBy(F.desc("score"), "query_id")
    return (
        seen.withColumn("score", score)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
        .select("snapshot_us", "place", "query_id", "score")
    )
