"""Per-query runtime statistics and the simple runtime models built on them.

Runtimes are microseconds in traces and statistics, seconds in predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.ordered import with_running
from querytide.functions.quantiles import exact_median
from querytide.operators.overlap import KEYS, neighbour_sweep, valid_runs
from querytide.operators.shaping import MICROS
from querytide.session import staged


def query_runtimes(trace: DataFrame, key: str = "query_idx") -> DataFrame:
    """Mean, median, population deviation, latest value and count per query."""
    latest = F.struct("start_us", "query_id")
    basics = trace.groupBy(key).agg(
        F.avg("run_us").alias("mean_us"),
        F.stddev_pop("run_us").alias("std_us"),
        F.max_by("run_us", latest).alias("latest_us"),
        F.count(F.lit(1)).alias("n"),
    )
    return basics.join(exact_median(trace, [key], "run_us", "median_us"), key)


def runtime_moments(trace: DataFrame, key: str = "query_idx") -> DataFrame:
    """What two batches need to be merged without error: exact sums, and the latest run."""
    run = F.col("run_us").cast("decimal(19,0)")
    return trace.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("run_us").alias("sum_us"),
        F.sum((run * run).cast("decimal(38,0)")).alias("sum_sq"),
        F.max(F.struct("start_us", "query_id", "run_us")).alias("latest"),
    )


def merge_moments(stored: DataFrame, new: DataFrame, key: str = "query_idx") -> DataFrame:
    """Stored statistics brought up to date with a new batch: every run counts once."""
    return (
        stored.unionByName(new)
        .groupBy(key)
        .agg(
            F.sum("n").alias("n"),
            F.sum("sum_us").alias("sum_us"),
            F.sum("sum_sq").alias("sum_sq"),
            F.max("latest").alias("latest"),
        )
    )


def moments_to_statistics(moments: DataFrame, key: str = "query_idx") -> DataFrame:
    n, total = F.col("n"), F.col("sum_us").cast("decimal(19,0)")
    # n * sum_sq - sum^2 is exact; only the final division and root are floating.
    spread = (n.cast("decimal(12,0)") * F.col("sum_sq") - total * total).cast("double")
    return moments.select(
        key,
        "n",
        (F.col("sum_us") / n).alias("mean_us"),
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("std_us"),
        F.col("latest.run_us").alias("latest_us"),
    )


def predict_cached(
    runs: DataFrame, statistics: DataFrame, alpha: float = 1.0, use_median: bool = False, key: str = "query_idx"
) -> DataFrame:
    """Middle and latest runtime mixed by ``alpha``; NULL for a query never seen."""
    middle = F.col("median_us" if use_median else "mean_us")
    mixed = (middle * alpha + F.col("latest_us") * (1 - alpha)) / MICROS
    known = statistics.select(key, mixed.alias("cached_s"))
    return runs.join(known, key, "left")


def feature_hash(features: Column, bits: int | None = None) -> Column:
    """A key for queries with equal features, optionally folded to ``2^bits`` values."""
    value = F.xxhash64(features)
    return value if bits is None else F.pmod(value, F.lit(1 << bits))


def predict_staged(
    runs: DataFrame, statistics: DataFrame, features: DataFrame, model: Column, floor: float = 0.01
) -> DataFrame:
    """The cached runtime where there is one, else the model's value, and the feature row
    ``[prediction, features...]``. ``model`` is a Column over ``features``."""
    cached = predict_cached(runs.join(features, "query_idx"), statistics)
    prediction = F.coalesce("cached_s", F.greatest(model, F.lit(floor)))
    return cached.withColumn("prediction_s", prediction).withColumn(
        "online", F.concat(F.array("prediction_s"), F.col("features").cast("array<double>"))
    )


def neighbour_counts(trace: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Valid runs with ``n_prior`` (earlier neighbours) and ``n_all`` neighbours."""
    swept = neighbour_sweep(valid_runs(trace), keys, payload=["query_idx", "start_us", "run_us"])
    return swept.select(
        *keys,
        "query_id",
        "query_idx",
        "start_us",
        "run_us",
        F.col("n_before").alias("n_prior"),
        (F.col("n_before") + F.col("n_after")).alias("n_all"),
    )


def isolated_runtime(counted: DataFrame) -> DataFrame:
    """Median runtime of the runs nothing overlapped, per query."""
    return exact_median(counted.where(F.col("n_all") == 0), ["query_idx"], "run_us", "isolated_us")


def average_runtime(counted: DataFrame) -> DataFrame:
    return counted.groupBy("query_idx").agg(F.avg("run_us").alias("average_us"))


def _slowdowns(counted: DataFrame, isolated: DataFrame, prior_only: bool) -> DataFrame:
    n = F.col("n_prior" if prior_only else "n_all").cast("double")
    return (
        counted.where(F.col("n_all") > 0)
        .join(isolated, "query_idx")
        .select("query_idx", n.alias("x"), (F.col("run_us") / F.col("isolated_us")).alias("y"))
    )


def _line(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    # All neighbours equal: a flat line through the mean.
    return rows.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("y", "x"), F.avg("y")).alias("intercept"),
    )


def fit_slowdown(
    counted: DataFrame, isolated: DataFrame, per_query: bool = True, prior_only: bool = True
) -> DataFrame:
    """``runtime / isolated = intercept + slope * neighbours``, one line per query or one for all."""
    return _line(_slowdowns(counted, isolated, prior_only), ["query_idx"] if per_query else [])


def _with_label(counted: DataFrame, isolated: DataFrame) -> DataFrame:
    return counted.join(isolated, "query_idx").withColumn("label_s", F.col("run_us") / MICROS)


def predict_slowdown(
    counted: DataFrame,
    isolated: DataFrame,
    lines: DataFrame,
    per_query: bool = True,
    prior_only: bool = True,
    floor: float = 0.001,
) -> DataFrame:
    rows = _with_label(counted, isolated)
    if per_query:
        rows = rows.join(lines, "query_idx")
        slope, intercept = F.col("slope"), F.col("intercept")
    else:
        slope, intercept = lines.select("slope").scalar(), lines.select("intercept").scalar()
    n = F.col("n_prior" if prior_only else "n_all")
    predicted = F.greatest((n * slope + intercept) * F.col("isolated_us") / MICROS, F.lit(floor))
    return rows.select("query_id", "query_idx", predicted.alias("prediction_s"), "label_s")


def predict_naive(counted: DataFrame, isolated: DataFrame) -> DataFrame:
    rows = _with_label(counted, isolated)
    return rows.select("query_id", "query_idx", (F.col("isolated_us") / MICROS).alias("prediction_s"), "label_s")


def queueing_curve(n: Column, isolated_s: Column, a1: Column, a2: Column, b1: Column) -> Column:
    """Time of waiting beyond ``b1`` neighbours plus the slowed-down isolated runtime."""
    return a1 * F.greatest(n - b1, F.lit(0)) + (1 + a2 * F.least(n, b1)) * isolated_s


def fit_queueing_curve(
    counted: DataFrame,
    isolated: DataFrame,
    levels: Sequence[int] | None = None,
    per_query: bool = True,
    prior_only: bool = True,
    min_runs: int = 10,
) -> DataFrame:
    """Least-squares ``a1, a2`` for every level ``b1`` and the level with the least error.

    Without ``levels`` they are all whole numbers up to the most neighbours seen
    (higher ones are singular). For a fixed level the curve is linear, so five sums
    solve it. On either side of a level those are polynomials in it, whose coefficients are
    running sums over the numbers of neighbours, so runs are not unfolded to levels.
    A singular level is no candidate.
    """
    keys = ["query_idx"] if per_query else []
    n = F.col("n_prior" if prior_only else "n_all")
    runs = counted.where(F.col("n_all") > 0).join(isolated, "query_idx")
    many = runs.groupBy("query_idx").agg(F.count(F.lit(1)).alias("_runs")).where(F.col("_runs") >= min_runs)
    runs = runs.join(many.select("query_idx"), "query_idx").select(
        *keys, n.cast("double").alias("n"), (F.col("isolated_us") / MICROS).alias("iso"), ((F.col("run_us") - F.col("isolated_us")) / MICROS).alias("z")
    )
    one, x, iso, z = F.lit(1.0), F.col("n"), F.col("iso"), F.col("z")
    terms = {
        "c": one, "n": x, "nn": x * x, "i": iso, "ni": x * iso, "ii": iso * iso, "nnii": x * x * iso * iso,
        "z": z, "nz": x * z, "iz": iso * z, "niz": x * iso * z,
    }
    merged = staged(runs.groupBy(*keys, "n").agg(*[F.sum(t).alias(f"_{k}") for k, t in terms.items()], F.sum(z * z).alias("_zz")), "merged")
    whole = merged.groupBy(*keys).agg(F.max("n").alias("_top"), F.sum("_zz").alias("zz"), *[F.sum(f"_{k}").alias(f"_all_{k}") for k in terms])
    steps = F.array(*[F.lit(b) for b in levels]) if levels is not None else F.sequence(F.lit(1), F.greatest("_top", F.lit(1)).cast("int"))
    grid = whole.select(*keys, F.explode(steps.cast("array<double>")).alias("n"), F.lit(1).alias("_tie"), *[F.lit(0.0).alias(f"_{k}") for k in terms])
    axis = merged.select(*keys, "n", F.lit(0).alias("_tie"), *[f"_{k}" for k in terms]).unionByName(grid)
    upto = with_running(axis, keys, ["n", "_tie"], {f"_upto_{k}": F.col(f"_{k}") for k in terms}).where("_tie = 1")
    whole = whole.drop("_top")
    upto = upto.join(whole, keys) if keys else upto.crossJoin(F.broadcast(whole))  # one row
    below = {k: F.col(f"_upto_{k}") for k in terms}
    above = {k: F.col(f"_all_{k}") - F.col(f"_upto_{k}") for k in terms}
    b = F.col("n")
    sums = upto.select(
        *keys,
        b.alias("b1"),
        (above["nn"] - 2 * b * above["n"] + b * b * above["c"]).alias("uu"),
        (b * (above["ni"] - b * above["i"])).alias("uv"),
        (below["nnii"] + b * b * above["ii"]).alias("vv"),
        (above["nz"] - b * above["z"]).alias("uz"),
        (below["niz"] + b * above["iz"]).alias("vz"),
        "zz",
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    solved = (
        sums.withColumn("_det", det)
        .where(F.col("_det") > 1e-9 * F.col("uu") * F.col("vv"))
        .withColumn("a1", (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / F.col("_det"))
        .withColumn("a2", (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / F.col("_det"))
        .withColumn("_sse", F.round(F.col("zz") - F.col("a1") * F.col("uz") - F.col("a2") * F.col("vz"), 4))
    )
    best = solved.groupBy(*keys).agg(F.min_by(F.struct("a1", "a2", "b1"), F.struct("_sse", "b1")).alias("_best"))
    return best.select(*keys, "_best.*")


def predict_queueing_curve(
    counted: DataFrame,
    isolated: DataFrame,
    curves: DataFrame,
    per_query: bool = True,
    prior_only: bool = True,
    floor: float = 0.001,
) -> DataFrame:
    rows = _with_label(counted, isolated)
    if per_query:
        rows = rows.join(curves, "query_idx")
        a1, a2, b1 = F.col("a1"), F.col("a2"), F.col("b1")
    else:
        a1, a2, b1 = (curves.select(c).scalar() for c in ("a1", "a2", "b1"))
    n = F.col("n_prior" if prior_only else "n_all").cast("double")
    value = queueing_curve(n, F.col("isolated_us") / MICROS, a1, a2, b1)
    return rows.select("query_id", "query_idx", F.greatest(value, F.lit(floor)).alias("prediction_s"), "label_s")
