"""Accuracy and latency reports.

Predictions are rows ``(query_id, query_idx, prediction_s, label_s)``. Reports are
long: one row per group and measure, all percentiles of a report from one ordering.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.quantiles import exact_median, exact_percentiles

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
WITH_P99 = {**PERCENTILES, "p99": 0.99}


def q_error(prediction: Column, label: Column) -> Column:
    """The larger of both ratios; infinite where just one side is 0, and 1 where both are."""
    both = F.greatest(F.try_divide(prediction, label), F.try_divide(label, prediction))
    one_zero = ((prediction == 0) | (label == 0)) & (prediction != label)
    return F.when(one_zero, F.lit(float("inf"))).when((prediction == 0) & (label == 0), F.lit(1.0)).otherwise(both)


def describe(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], probs: Mapping[str, float] = PERCENTILES
) -> DataFrame:
    """Count, mean and percentiles of several measures per group."""
    entries = F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("_m")) for n, c in measures.items()])
    long = df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*").where(F.col("_m").isNotNull())
    on = [*keys, "measure"]
    basics = long.groupBy(*on).agg(F.count("_m").alias("n"), F.avg("_m").alias("mean"))
    return basics.join(exact_percentiles(long, on, "_m", probs), on)


def _errors() -> dict[str, Column]:
    prediction, label = F.col("prediction_s"), F.col("label_s")
    return {"absolute": F.abs(prediction - label), "q": q_error(prediction, label)}


def overall(predictions: DataFrame) -> DataFrame:
    return describe(predictions, [], _errors())


def per_query(predictions: DataFrame) -> DataFrame:
    return describe(predictions, ["query_idx"], _errors())


def by_runtime_interval(predictions: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Errors per runtime interval; a query belongs to the interval of its median label."""
    interval = F.lit(None).cast("int")
    for number, low in reversed(list(enumerate(edges))):
        high = edges[number + 1] if number + 1 < len(edges) else float("inf")
        inside = (F.col("_median") >= low) & (F.col("_median") < high)
        interval = F.when(inside, number).otherwise(interval)
    medians = exact_median(predictions, ["query_idx"], "label_s", "_median")
    placed = medians.select("query_idx", interval.alias("interval")).where(F.col("interval").isNotNull())
    return describe(predictions.join(placed, "query_idx"), ["interval"], _errors(), WITH_P99)


def by_template(predictions: DataFrame, templates: DataFrame) -> DataFrame:
    """q-errors per template; ``templates`` is ``(query_idx, template)``."""
    joined = predictions.join(templates, "query_idx")
    return describe(joined, ["template"], {"q": _errors()["q"]}, {"p50": 0.5, "p90": 0.9, "p99": 0.99})


# Fixed values of the loss: estimates below ``least`` cost ``below_least`` per second short of 1; where estimate and truth are below
# ``short``, their difference counts ``short_weight``-fold.
LOSS_VALUES = {"least": 0.001, "short": 5.0, "below_least": 1e5, "short_weight": 0.1}


def q_loss(prediction: Column, label: Column, **changed: float) -> Column:
    """The absolute log ratio of estimate and truth, but for small values (``LOSS_VALUES``, which ``changed`` replaces)."""
    v = LOSS_VALUES | changed
    both_short = F.greatest(prediction, label) < v["short"]
    ratio = F.abs(F.log(prediction) - F.log(label))
    usual = F.when(both_short, v["short_weight"] * F.abs(prediction - label)).otherwise(ratio)
    return F.when(prediction >= v["least"], usual).otherwise(v["below_least"] * (1 - prediction))


def latency(results: DataFrame) -> DataFrame:
    """Execution and end-to-end times of finished runs."""
    done = results.where((F.col("exec_us") >= 0) & (F.col("e2e_us") >= 0))
    return describe(done, [], {"exec_us": F.col("exec_us"), "e2e_us": F.col("e2e_us")}, WITH_P99)


def queueing(results: DataFrame) -> DataFrame:
    done = results.where((F.col("exec_us") >= 0) & (F.col("e2e_us") >= 0))
    return describe(done, [], {"queueing_us": F.greatest(F.col("e2e_us") - F.col("exec_us"), F.lit(0))}, WITH_P99)


def compare_runs(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs of one trace, joined per query: both summaries, the difference and the ratio."""
    done = lambda r, n: r.where((F.col("exec_us") >= 0) & (F.col("e2e_us") >= 0)).select(
        "query_id", F.col("e2e_us").alias(n)
    )
    both = done(baseline, "baseline_us").join(done(other, "other_us"), "query_id")
    a, b = F.col("baseline_us"), F.col("other_us")
    measures = {"baseline_us": a, "other_us": b, "difference_us": b - a, "ratio": F.when(a > 0, b / a)}
    return describe(both, [], measures, WITH_P99)
