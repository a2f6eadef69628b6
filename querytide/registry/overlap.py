"""Interval overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querytide.operators import overlap as o
from querytide.registry.base import register, view

# An earlier row overlaps a later one that starts before its end.
ORDERED = """ordered AS (
  SELECT a.database_id, a.query_id AS earlier_id, b.query_id AS later_id
  FROM {src} a JOIN {src} b ON a.database_id = b.database_id
   AND (a.start_us, a.query_id) < (b.start_us, b.query_id) AND b.start_us < a.start_us + a.run_us)"""
PAIRS = (
    ORDERED
    + """,
pairs AS (
  SELECT database_id, later_id AS query_id, earlier_id AS other_query_id, true AS is_earlier FROM ordered
  UNION ALL
  SELECT database_id, earlier_id, later_id, false FROM ordered)"""
)
RECENT = """recent AS (
  SELECT a.database_id, a.query_id, b.query_id AS other_query_id
  FROM {src} a JOIN {src} b ON a.database_id = b.database_id AND a.query_id <> b.query_id
   AND b.start_us + b.run_us <= a.start_us AND b.start_us + b.run_us > a.start_us - {us}
   AND (b.start_us, b.query_id) < (a.start_us, a.query_id))"""
VALID = "valid AS (SELECT * FROM trace WHERE run_us > 0 AND NOT error)"
LOOKBACK_US = 20_000_000
# What the source looks back for just finished queries.
RECENT_US = 200_000_000


def pairs_of(src: str) -> str:
    return PAIRS.replace("{src}", src)


def recent_of(src: str, us: int = LOOKBACK_US) -> str:
    return RECENT.replace("{src}", src).replace("{us}", str(us))


COUNTS = """counts AS (
  SELECT t.database_id, t.query_id, count(p.other_query_id) AS n_concurrent
  FROM {src} t LEFT JOIN pairs p ON p.query_id = t.query_id GROUP BY ALL)"""


@register(
    "conc_predecessors", "trace",
    "SELECT database_id, later_id AS query_id, earlier_id AS other_query_id FROM ordered",
    ORDERED.replace("{src}", "trace"),
)
def conc_predecessors(spark, sf):
    return o.predecessors(view(spark, sf, "trace"))


@register(
    "conc_successors", "trace",
    """SELECT database_id, query_id, other_query_id FROM (
  SELECT ordered.database_id, earlier_id AS query_id, later_id AS other_query_id,
    row_number() OVER (PARTITION BY earlier_id ORDER BY t.start_us, later_id) AS pos
  FROM ordered JOIN trace t ON t.query_id = later_id)""",
    ORDERED.replace("{src}", "trace"),
)
def conc_successors(spark, sf):
    return o.successors(view(spark, sf, "trace"))


@register("conc_overlap_pairs", "trace", "SELECT * FROM pairs", pairs_of("trace"))
def conc_overlap_pairs(spark, sf):
    return o.overlap_pairs(view(spark, sf, "trace"))


@register("conc_recent_finished", "trace", "SELECT * FROM recent", recent_of("trace", RECENT_US))
def conc_recent_finished(spark, sf):
    return o.recently_finished(view(spark, sf, "trace"), RECENT_US)


@register(
    "conc_dataset", "trace",
    """SELECT v.query_id, v.query_idx, v.start_us, v.start_us + v.run_us AS end_us,
  CAST(count(p.other_query_id) AS BIGINT) AS num_concurrent_queries,
  CAST(count(CASE WHEN p.is_earlier THEN 1 END) AS BIGINT) AS num_concurrent_queries_train,
  CAST(coalesce(sum(b.start_us), 0) AS BIGINT) AS sum_start,
  CAST(coalesce(sum(CASE WHEN p.is_earlier THEN b.start_us + b.run_us END), 0) AS BIGINT) AS sum_end_train,
  CAST(coalesce(sum(b.query_idx), 0) AS BIGINT) AS sum_idx,
  CAST((SELECT count(*) FROM recent r WHERE r.query_id = v.query_id) AS BIGINT) AS num_recent
FROM valid v LEFT JOIN pairs p ON p.query_id = v.query_id LEFT JOIN valid b ON b.query_id = p.other_query_id
GROUP BY v.query_id, v.query_idx, v.start_us, v.run_us""",
    f"{VALID}, {pairs_of('valid')}, {recent_of('valid')}",
)
def conc_dataset(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    data = o.concurrency_dataset(view(spark, sf, "trace"), LOOKBACK_US)
    return data.select(
        "query_id", "query_idx", "start_us", "end_us",
        F.col("num_concurrent_queries").cast("bigint").alias("num_concurrent_queries"),
        F.col("num_concurrent_queries_train").cast("bigint").alias("num_concurrent_queries_train"),
        total(F.transform("concur_info", lambda x: x["start_us"])).alias("sum_start"),
        total(F.transform("concur_info_train", lambda x: x["end_us"])).alias("sum_end_train"),
        total(F.transform("concur_info", lambda x: x["query_idx"].cast("bigint"))).alias("sum_idx"),
        F.size("pre_exec_info").cast("bigint").alias("num_recent"),
    )


@register(
    "conc_count", "trace", "SELECT query_id, n_concurrent FROM counts",
    f"{pairs_of('trace')}, {COUNTS.replace('{src}', 'trace')}",
)
def conc_count(spark, sf):
    return o.concurrency_counts(view(spark, sf, "trace"))


@register(
    "conc_count_by_database", "trace",
    """SELECT database_id, query_id, n_concurrent FROM counts WHERE database_id IN (
  SELECT database_id FROM trace GROUP BY 1 HAVING count(*) > 200)""",
    f"{pairs_of('trace')}, {COUNTS.replace('{src}', 'trace')}",
)
def conc_count_by_database(spark, sf):
    return o.concurrency_by_database(view(spark, sf, "trace"), min_queries=200)
