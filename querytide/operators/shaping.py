"""Cleaning, aligning, splitting and re-timing traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.ordered import OrderedRows, with_row_number
from querytide.operators.overlap import KEYS, neighbour_sweep

MICROS = 1_000_000


def normalize_warehouse(log: DataFrame) -> DataFrame:
    """Warehouse log (milliseconds, timestamps) to trace columns, timed from the first query."""
    at = F.unix_micros(F.col("createdTime").cast("timestamp"))
    first = log.agg(F.min(at)).scalar()
    return log.select(
        "query_id",
        F.col("databaseId").alias("database_id"),
        at.alias("timestamp_us"),
        (at - first).alias("start_us"),
        (F.col("durationTotal") * 1000).alias("run_us"),
    )


def engine_runs(trace: DataFrame, engine: str) -> DataFrame:
    """Runs of one engine; apply before any overlap so that neighbours are filtered too."""
    return trace.where(F.col("engine") == engine)


def with_offset(trace: DataFrame) -> DataFrame:
    """Time since the earliest start over all clients."""
    first = trace.agg(F.min("start_us")).scalar()
    return trace.withColumn("offset_us", F.col("start_us") - first)


def with_issue_gap(trace: DataFrame, client: str = "client_id") -> DataFrame:
    """Per client the time since its previous start; a first row keeps its own offset."""
    rows = OrderedRows(trace, [client], ["start_us", "query_id"]).add_previous("start_us", "_previous").rows()
    gap = F.col("start_us") - F.coalesce("_previous", F.lit(0))
    return rows.withColumn("gap_us", gap).drop("_previous")


def fill_binds(sql: Column, binds: Column) -> Column:
    """Put binds into ``:1 .. :n``, highest number first; a NULL bind ends the filling."""
    holes = F.when(F.size(binds) > 0, F.sequence(F.size(binds), F.lit(1), F.lit(-1))).otherwise(
        F.expr("cast(array() as array<int>)")
    )

    def fill(state: Column, number: Column) -> Column:
        bind = F.get(binds, number - 1)
        ended = state["ended"] | bind.isNull()
        hole = F.concat(F.lit(":"), number.cast("string"))
        text = F.when(ended, state["text"]).otherwise(F.replace(state["text"], hole, bind))
        return F.struct(text.alias("text"), ended.alias("ended"))

    start = F.struct(sql.alias("text"), F.lit(False).alias("ended"))
    return F.aggregate(holes, start, fill, lambda state: state["text"])


def with_query_ids(
    runs: DataFrame, sql: str = "query_sql", order: str = "ord", template: str = "template_id"
) -> DataFrame:
    """Number distinct texts from 0 by first appearance and attach number and template."""
    texts = runs.groupBy(sql).agg(
        F.min(order).alias("_first"), F.min_by(template, order).alias("query_template_idx")
    )
    numbered = with_row_number(texts, [], ["_first"], "_number")
    ids = numbered.select(sql, (F.col("_number") - 1).alias("query_idx"), "query_template_idx")
    return runs.drop(template).join(ids, sql)


def _from_first_start(log: DataFrame) -> Column:
    first = log.agg(F.min(F.when(F.col("start_us") >= 0, F.col("start_us")))).scalar()
    return F.col("start_us") - first + F.greatest(F.col("e2e_us") - F.col("exec_us"), F.lit(0))


def realign_start(log: DataFrame) -> DataFrame:
    """Start of execution instead of submission: queueing time is added to the start and
    the execution time becomes the run time. Unfinished and failed rows are left out."""
    return (
        log.withColumn("start_us", _from_first_start(log))
        .where((F.col("exec_us") > 0) & ~F.col("error"))
        .withColumn("run_us", F.col("exec_us"))
    )


def trace_from_results(trace: DataFrame, results: DataFrame, first_id: int = 0) -> DataFrame:
    """Measured times joined to the submitted trace by row id, from ``first_id`` on."""
    kept = trace.where(F.col("query_id") >= first_id).select("query_id", "query_idx", "start_us")
    timed = kept.join(results.select("query_id", "exec_us", "e2e_us"), "query_id")
    return (
        timed.withColumn("start_us", _from_first_start(kept))
        .where((F.col("exec_us") >= 0) & (F.col("e2e_us") >= 0))
        .select("query_id", "query_idx", F.col("exec_us").alias("run_us"), "e2e_us", "start_us")
    )


def assemble_results(
    submitted: DataFrame,
    exec_times: DataFrame,
    e2e_times: DataFrame,
    start_times: DataFrame,
    timeouts: DataFrame,
    errors: DataFrame,
) -> DataFrame:
    """One row per submitted query with whatever was logged about it, NULL when nothing was.

    All logs are stacked and grouped once, one shuffle in place of five joins.
    """
    kinds = {
        "query_idx": (submitted, "int"),
        "exec_us": (exec_times, "bigint"),
        "e2e_us": (e2e_times, "bigint"),
        "start_us": (start_times, "bigint"),
    }

    def entry(source: DataFrame, filled: str) -> DataFrame:
        return source.select(
            "query_id",
            *[(F.col(c) if c == filled else F.lit(None)).cast(k).alias(c) for c, (_, k) in kinds.items()],
            *[F.lit(flag == filled).alias(flag) for flag in ("submitted", "timeout", "error")],
        )

    stacked = entry(submitted, "submitted").unionByName(entry(submitted, "query_idx"))
    for filled in ("exec_us", "e2e_us", "start_us"):
        stacked = stacked.unionByName(entry(kinds[filled][0], filled))
    stacked = stacked.unionByName(entry(timeouts, "timeout")).unionByName(entry(errors, "error"))
    names = [*kinds, "submitted", "timeout", "error"]
    rows = stacked.groupBy("query_id").agg(*[F.max(c).alias(c) for c in names])
    return rows.where("submitted").drop("submitted")


def compress_idle(trace: DataFrame, threshold_us: int = 400 * MICROS, keys: Sequence[str] = ()) -> DataFrame:
    """Pull everything after a long pause back, so that no pause between starts exceeds the threshold."""
    ordered = OrderedRows(trace, keys, ["start_us", "query_id"]).add_previous("start_us", "_previous")
    excess = F.greatest(
        F.col("start_us") - F.coalesce("_previous", F.lit(0)) - threshold_us, F.lit(0)
    )
    rows = ordered.add_running({"_offset": excess}).rows()
    return rows.withColumn("start_us", F.col("start_us") - F.col("_offset")).drop("_previous", "_offset")


def _uniform(row_id: str, seed: int, draw: int) -> Column:
    bits = F.xxhash64(F.col(row_id), F.lit(seed), F.lit(draw))
    return (F.pmod(bits, F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))


def stable_normal(row_id: str, seed: int) -> Column:
    """A standard normal draw fixed by row id and seed, whatever the partitioning."""
    return F.sqrt(-2 * F.log(_uniform(row_id, seed, 0))) * F.cos(2 * F.pi() * _uniform(row_id, seed, 1))


def stretch_gaps(
    trace: DataFrame, mean_us: int, sd_us: int, seed: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """Widen every gap below ``mean + sd`` by the size of a normal draw; later rows move along."""
    ordered = OrderedRows(trace, keys, ["start_us", "query_id"]).add_previous("start_us", "_previous")
    draw = F.abs(stable_normal("query_id", seed) * sd_us + mean_us).cast("bigint")
    short = F.col("start_us") - F.col("_previous") < mean_us + sd_us
    rows = ordered.add_running({"_added": F.when(short, draw).otherwise(0)}).rows()
    return rows.withColumn("start_us", F.col("start_us") + F.col("_added")).drop("_previous", "_added")


def split_random(
    trace: DataFrame,
    train_percent: int = 80,
    seed: int = 0,
    percentile: Column | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``part`` = train or test by a stable hash of the id; test keeps runs with neighbours.

    ``percentile`` (0..99 per row) replaces the hash.
    """
    place = percentile if percentile is not None else F.pmod(F.xxhash64(F.col("query_id"), F.lit(seed)), F.lit(100))
    swept = neighbour_sweep(trace, keys, payload=[c for c in trace.columns if c not in (*keys, "query_id")])
    part = F.when(place < train_percent, "train").otherwise("test")
    busy = F.col("n_before") + F.col("n_after") > 0
    return swept.withColumn("part", part).where((F.col("part") == "train") | busy).drop("rank")


def split_by_prior_information(trace: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs that no later query joins are test (if anything ran beside them), others train."""
    swept = neighbour_sweep(trace, keys, payload=[c for c in trace.columns if c not in (*keys, "query_id")])
    part = F.when(F.col("n_after") > 0, "train").when(F.col("n_before") > 0, "test")
    return swept.withColumn("part", part).where(F.col("part").isNotNull()).drop("rank")


# Upper edges in seconds of the average-runtime buckets.
RUNTIME_EDGES_S = (5, 30, 60, 100)


def runtime_bucket(run_us: Column) -> Column:
    """0 for short queries, then one number per bucket; edges belong to the lower bucket."""
    bucket = F.lit(len(RUNTIME_EDGES_S))
    for number in range(len(RUNTIME_EDGES_S) - 1, -1, -1):
        bucket = F.when(run_us <= RUNTIME_EDGES_S[number] * MICROS, number).otherwise(bucket)
    return bucket


def assign_by_runtime(trace: DataFrame, bank: DataFrame, pick: Column | None = None) -> DataFrame:
    """For each trace row a bank query of the same runtime bucket, chosen by a stable hash.

    ``bank`` has ``query_idx, avg_us``. The number of members per bucket is a
    table of at most five rows.
    """
    chosen = pick if pick is not None else F.xxhash64("query_id")
    numbered = with_row_number(
        bank.select("query_idx", runtime_bucket(F.col("avg_us")).alias("bucket")), ["bucket"], ["query_idx"], "_number"
    )
    sizes = numbered.groupBy("bucket").agg(F.max("_number").alias("_size"))
    placed = (
        trace.drop("query_idx")
        .withColumn("bucket", runtime_bucket(F.col("run_us")))
        .join(F.broadcast(sizes), "bucket")
        .withColumn("_number", F.pmod(chosen, F.col("_size")) + 1)
    )
    return placed.join(numbered, ["bucket", "_number"]).drop("_number", "_size")


def nearest_runtime(targets: DataFrame, bank: DataFrame, row_id: str = "query_id", value: str = "run_us") -> DataFrame:
    """The bank query with the smallest ``avg_us`` not below the target, else the slowest one.

    Bank and targets share one axis; a target reads how many bank queries lie
    below it, which is the position of its match.
    """
    stacked = targets.select(
        F.col(value).cast("bigint").alias("_at"), F.lit(0).alias("_tie"), F.col(row_id).alias("_id")
    ).unionByName(
        bank.select(F.col("avg_us").cast("bigint").alias("_at"), F.lit(1).alias("_tie"), F.col("query_idx").cast("bigint").alias("_id"))
    )
    rows = OrderedRows(stacked, [], ["_at", "_tie", "_id"]).add_running({"_below": F.col("_tie").cast("bigint")}).rows()
    size = bank.agg(F.count(F.lit(1))).scalar()
    matches = rows.where("_tie = 1").select(
        F.col("_below").alias("_position"), F.col("_id").alias("bank_query_idx"), F.col("_at").alias("bank_us")
    )
    placed = rows.where("_tie = 0").select(
        F.col("_id").alias(row_id), F.col("_at").alias(value), F.least(F.col("_below") + 1, size).alias("_position")
    )
    return placed.join(matches, "_position").drop("_position")


def time_of_day(elapsed_us: Column, factor: int) -> Column:
    """Scaled minute of the day as ``HH:MM``."""
    minute = F.pmod(F.floor(elapsed_us * factor / (60 * MICROS)), F.lit(1440))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(two(F.floor(minute / 60)), F.lit(":"), two(F.pmod(minute, F.lit(60))))


def on_day_type(
    trace: DataFrame, day_type: str = "all", dates: DataFrame | None = None, at: str = "created_time"
) -> DataFrame:
    """Rows on weekdays, on weekends or on all days, within a list of dates if one is given."""
    if day_type not in ("all", "weekday", "weekend"):
        raise ValueError(f"day_type: {day_type}")
    rows = trace
    if dates is not None:
        day = F.to_date(at)
        wanted = dates.select(F.col("date").alias("_date")).distinct()
        rows = rows.withColumn("_date", day).join(wanted, "_date", "left_semi").drop("_date")
    if day_type != "all":
        weekend = F.dayofweek(at).isin(1, 7)
        rows = rows.where(weekend if day_type == "weekend" else ~weekend)
    return rows


