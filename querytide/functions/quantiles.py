"""Exact interpolated percentiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.functions.ordered import with_running


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Percentiles per key with linear interpolation, one row per key.

    Equal values are merged first (map-side), the distinct ones get a running
    count, and only the two neighbours of each wanted position are kept. The
    built-in ``percentile`` keeps every distinct value of a group in one task.
    """
    if not keys:
        one = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs)
        return one.drop("_all")
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = with_running(counts, keys, ["_v"], {"_upto": F.col("_n")})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    with_size = ranked.join(sizes, keys)
    last, aggs = F.col("_size") - 1, []
    for name, prob in probs.items():
        at = last * F.lit(float(prob))
        low = F.floor(at)
        held = lambda pos: (F.col("_upto") - F.col("_n") <= pos) & (F.col("_upto") > pos)
        aggs += [
            F.max(F.when(held(low), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(held(F.least(low + 1, last)), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
    picked = with_size.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_percentiles(df, keys, value, {name: 0.5})
