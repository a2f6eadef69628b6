"""What SQL texts say about the tables they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.quantiles import exact_median

# A join condition with bare and with quoted names.
BARE_CONDITION = r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"
QUOTED_CONDITION = r'"(\w+)"\."(\w+)"\s*=\s*"(\w+)"\."(\w+)"'
SOURCE_SUFFIX = "_brad_source"

SIDES = ("t1", "c1", "t2", "c2")


def _matches(sql: Column, pattern: str) -> Column:
    """All matches as an array of structs, one field per side."""
    groups = [F.regexp_extract_all(sql, F.lit(pattern), F.lit(i)) for i in range(1, 5)]
    return F.arrays_zip(*[g.alias(n) for g, n in zip(groups, SIDES)])


def join_conditions(sql: Column) -> Column:
    """Every ``t1.c1 = t2.c2`` in reading order; the quoted form only where no bare one is found."""
    bare = _matches(sql, BARE_CONDITION)
    return F.when(F.size(bare) > 0, bare).otherwise(_matches(sql, QUOTED_CONDITION))


def canonical_conditions(conditions: Column, source_suffix: bool = False) -> Column:
    """Sides in table order (a self join is turned), without repeats, sorted."""

    def table(name: Column) -> Column:
        if not source_suffix:
            return name
        return F.when(F.endswith(name, F.lit(SOURCE_SUFFIX)), name).otherwise(F.concat(name, F.lit(SOURCE_SUFFIX)))

    def turned(c: Column) -> Column:
        left = F.struct(table(c["t1"]).alias("t"), c["c1"].alias("c"))
        right = F.struct(table(c["t2"]).alias("t"), c["c2"].alias("c"))
        kept = left["t"] < right["t"]
        first, second = F.when(kept, left).otherwise(right), F.when(kept, right).otherwise(left)
        return F.struct(
            first["t"].alias("t1"), first["c"].alias("c1"), second["t"].alias("t2"), second["c"].alias("c2")
        )

    return F.array_sort(F.array_distinct(F.transform(conditions, turned)))


def condition_text(condition: Column) -> Column:
    return F.format_string("%s.%s = %s.%s", *[condition[n] for n in SIDES])


def touched_tables(sql: Column) -> Column:
    """Names of all joined tables, sorted."""
    conditions = join_conditions(sql)
    names = F.concat(F.transform(conditions, lambda c: c["t1"]), F.transform(conditions, lambda c: c["t2"]))
    return F.array_sort(F.array_distinct(names))


def table_multihot(sql: Column, tables: Sequence[str]) -> Column:
    """0/1 per table of a fixed list, in its order."""
    touched = touched_tables(sql)
    return F.array(*[F.array_contains(touched, t).cast("int") for t in tables])


def with_table_count(trace: DataFrame, query_text: DataFrame) -> DataFrame:
    """Attach the number of joined tables of each row's query."""
    counted = query_text.select("query_idx", F.size(touched_tables(F.col("sql"))).alias("num_tables"))
    return trace.join(counted, "query_idx", "left")


def runtime_table_features(trace: DataFrame, query_text: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Per query: multi-hot tables, median and population standard deviation of its runtime (us)."""
    spread = trace.groupBy("query_idx").agg(F.stddev_pop("run_us").alias("std_us"))
    runtimes = spread.join(exact_median(trace, ["query_idx"], "run_us", "median_us"), "query_idx")
    hot = query_text.select("query_idx", table_multihot(F.col("sql"), tables).alias("tables"))
    return runtimes.join(hot, "query_idx")
