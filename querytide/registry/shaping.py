"""Trace shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querytide.operators import overlap as o
from querytide.operators import shaping as s
from querytide.registry.base import register, view
from querytide.registry.overlap import pairs_of

NEIGHBOURS = """sides AS (
  SELECT t.query_id, count(p.other_query_id) AS n, count(CASE WHEN p.is_earlier THEN 1 END) AS n_before
  FROM trace t LEFT JOIN pairs p ON p.query_id = t.query_id GROUP BY 1)"""
BANK = "bank AS (SELECT query_idx, CAST(sum(run_us) // count(*) AS BIGINT) AS avg_us FROM trace GROUP BY 1)"


def bank(spark, sf):
    return view(spark, sf, "trace").groupBy("query_idx").agg(F.expr("sum(run_us) div count(1)").alias("avg_us"))


@register(
    "trace_normalize_warehouse", "warehouse",
    """SELECT query_id, databaseId AS database_id, epoch_us(createdTime) AS timestamp_us,
  epoch_us(createdTime) - (SELECT min(epoch_us(createdTime)) FROM warehouse) AS start_us,
  durationTotal * 1000 AS run_us FROM warehouse""",
)
def trace_normalize_warehouse(spark, sf):
    return s.normalize_warehouse(view(spark, sf, "warehouse"))


@register("trace_valid_runs", "trace", "SELECT query_id, run_us FROM trace WHERE run_us > 0 AND NOT error")
def trace_valid_runs(spark, sf):
    return o.valid_runs(view(spark, sf, "trace")).select("query_id", "run_us")


@register("trace_engine_filter", "trace", "SELECT query_id, engine FROM trace WHERE engine = 'redshift'")
def trace_engine_filter(spark, sf):
    return s.engine_runs(view(spark, sf, "trace"), "redshift").select("query_id", "engine")


@register(
    "trace_offset", "trace",
    "SELECT query_id, start_us - (SELECT min(start_us) FROM trace) AS offset_us FROM trace",
)
def trace_offset(spark, sf):
    return s.with_offset(view(spark, sf, "trace")).select("query_id", "offset_us")


@register(
    "trace_issue_gap", "trace",
    """SELECT query_id, client_id, start_us - coalesce(
  lag(start_us) OVER (PARTITION BY client_id ORDER BY start_us, query_id), 0) AS gap_us FROM trace""",
)
def trace_issue_gap(spark, sf):
    return s.with_issue_gap(view(spark, sf, "trace")).select("query_id", "client_id", "gap_us")


# Only the third bind can be NULL: then 11..4 are filled and 3..1 stay.
FILLED = """steps AS (
  SELECT r.ord, r.template_id, r.arguments, replace(replace(replace(replace(replace(replace(replace(replace(
    t.sql, ':11', arguments[11]), ':10', arguments[10]), ':9', arguments[9]), ':8', arguments[8]),
    ':7', arguments[7]), ':6', arguments[6]), ':5', arguments[5]), ':4', arguments[4]) AS upper
  FROM cab_trace r JOIN cab_templates t ON r.template_id = t.template_id),
filled AS (
  SELECT ord, template_id, CASE WHEN arguments[3] IS NULL THEN upper ELSE replace(replace(replace(
    upper, ':3', arguments[3]), ':2', arguments[2]), ':1', arguments[1]) END AS query_sql FROM steps)"""


def filled_runs(spark, sf):
    runs = view(spark, sf, "cab_trace").join(view(spark, sf, "cab_templates"), "template_id")
    return runs.select("ord", "template_id", s.fill_binds(F.col("sql"), F.col("arguments")).alias("query_sql"))


@register("trace_fill_binds", "cab_trace cab_templates", "SELECT ord, template_id, query_sql FROM filled", FILLED)
def trace_fill_binds(spark, sf):
    return filled_runs(spark, sf)


QUERY_IDS = (
    FILLED
    + """,
texts AS (
  SELECT query_sql, min(template_id) AS query_template_idx, row_number() OVER (ORDER BY min(ord)) - 1 AS query_idx
  FROM filled GROUP BY query_sql)"""
)


@register(
    "trace_query_ids", "cab_trace cab_templates",
    "SELECT ord, query_sql, query_idx, query_template_idx FROM filled JOIN texts USING (query_sql)", QUERY_IDS,
)
def trace_query_ids(spark, sf):
    return s.with_query_ids(filled_runs(spark, sf))


SHIFT = """start_us - (SELECT min(start_us) FROM {src} WHERE start_us >= 0) + greatest(e2e_us - exec_us, 0)"""


@register(
    "trace_realign_start", "result_log",
    f"""SELECT query_id, query_idx, {SHIFT.replace('{src}', 'result_log')} AS start_us, exec_us AS run_us, e2e_us
FROM result_log WHERE exec_us > 0 AND NOT error""",
)
def trace_realign_start(spark, sf):
    return s.realign_start(view(spark, sf, "result_log")).select(
        "query_id", "query_idx", "start_us", "run_us", "e2e_us"
    )


@register(
    "trace_from_results", "result_log",
    f"""SELECT query_id, query_idx, exec_us AS run_us, e2e_us, {SHIFT.replace('{src}', 'result_log')} AS start_us
FROM result_log WHERE exec_us >= 0 AND e2e_us >= 0""",
)
def trace_from_results(spark, sf):
    return s.trace_from_results(view(spark, sf, "trace"), view(spark, sf, "result_log"))


@register(
    "trace_result_assemble", "result_log",
    """SELECT query_id, query_idx, CASE WHEN exec_us >= 0 THEN exec_us END AS exec_us,
  CASE WHEN query_id % 7 <> 0 THEN e2e_us END AS e2e_us, start_us, timeout, error FROM result_log""",
)
def trace_result_assemble(spark, sf):
    log = view(spark, sf, "result_log")
    return s.assemble_results(
        log.select("query_id", "query_idx"),
        log.where("exec_us >= 0").select("query_id", "exec_us"),
        log.where("query_id % 7 <> 0").select("query_id", "e2e_us"),
        log.select("query_id", "start_us"),
        log.where("timeout").select("query_id"),
        log.where("error").select("query_id"),
    )


@register(
    "trace_compress_idle", "trace",
    """SELECT query_id, client_id, start_us - sum(greatest(start_us - prev - 400000000, 0)) OVER (
  PARTITION BY client_id ORDER BY start_us, query_id)::BIGINT AS start_us FROM (
  SELECT *, coalesce(lag(start_us) OVER (PARTITION BY client_id ORDER BY start_us, query_id), 0) AS prev FROM trace)""",
)
def trace_compress_idle(spark, sf):
    return s.compress_idle(view(spark, sf, "trace"), keys=["client_id"]).select("query_id", "client_id", "start_us")


@register(
    "trace_stretch_gaps", "trace",
    """SELECT query_id, start_us + sum(CASE WHEN start_us - prev < 5000000 THEN 5000000 ELSE 0 END) OVER (
  ORDER BY start_us, query_id)::BIGINT AS start_us FROM (
  SELECT *, lag(start_us) OVER (ORDER BY start_us, query_id) AS prev FROM trace)""",
)
def trace_stretch_gaps(spark, sf):
    return s.stretch_gaps(view(spark, sf, "trace"), 5_000_000, 0).select("query_id", "start_us")


@register(
    "trace_split_random", "trace",
    """SELECT query_id, CASE WHEN query_id % 5 < 4 THEN 'train' ELSE 'test' END AS part
FROM sides WHERE query_id % 5 < 4 OR n > 0""",
    f"{pairs_of('trace')}, {NEIGHBOURS}",
)
def trace_split_random(spark, sf):
    split = s.split_random(view(spark, sf, "trace"), percentile=F.col("query_id") % 5 * 20)
    return split.select("query_id", "part")


@register(
    "trace_split_pre_info", "trace",
    """SELECT query_id, CASE WHEN n > n_before THEN 'train' ELSE 'test' END AS part FROM sides WHERE n > 0""",
    f"{pairs_of('trace')}, {NEIGHBOURS}",
)
def trace_split_pre_info(spark, sf):
    return s.split_by_prior_information(view(spark, sf, "trace")).select("query_id", "part")


BUCKET = """CASE WHEN {c} <= 5000000 THEN 0 WHEN {c} <= 30000000 THEN 1 WHEN {c} <= 60000000 THEN 2
  WHEN {c} <= 100000000 THEN 3 ELSE 4 END"""


@register(
    "trace_assign_by_runtime", "trace",
    f"""SELECT t.query_id, t.run_us, CAST(n.bucket AS INT) AS bucket, n.query_idx
FROM trace t JOIN numbered n ON n.bucket = {BUCKET.replace('{c}', 't.run_us')} AND n.pos = t.query_id % n.size""",
    f"""{BANK}, numbered AS (SELECT bucket, query_idx, row_number() OVER (PARTITION BY bucket ORDER BY query_idx) - 1 AS pos,
  count(*) OVER (PARTITION BY bucket) AS size FROM (SELECT query_idx, {BUCKET.replace('{c}', 'avg_us')} AS bucket FROM bank))""",
)
def trace_assign_by_runtime(spark, sf):
    placed = s.assign_by_runtime(view(spark, sf, "trace"), bank(spark, sf), F.col("query_id"))
    return placed.select("query_id", "run_us", "bucket", "query_idx")


@register(
    "trace_nearest_runtime", "trace",
    """SELECT t.query_id, t.run_us, b.query_idx AS bank_query_idx, b.avg_us AS bank_us FROM trace t, bank b
WHERE b.query_idx = coalesce(
  (SELECT arg_min(query_idx, (avg_us, query_idx)) FROM bank WHERE avg_us >= t.run_us),
  (SELECT arg_max(query_idx, (avg_us, query_idx)) FROM bank))""",
    BANK.replace("query_idx,", "CAST(query_idx AS BIGINT) AS query_idx,", 1),
)
def trace_nearest_runtime(spark, sf):
    return s.nearest_runtime(view(spark, sf, "trace"), bank(spark, sf))


@register(
    "trace_time_of_day", "trace",
    """SELECT query_id, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS time_of_day
FROM (SELECT query_id, start_us * 4 // 60000000 % 1440 AS m FROM trace)""",
)
def trace_time_of_day(spark, sf):
    return view(spark, sf, "trace").select("query_id", s.time_of_day(F.col("start_us"), 4).alias("time_of_day"))


@register(
    "trace_filter_day_type", "trace",
    "SELECT query_id, CAST(created_time AS DATE) AS day FROM trace WHERE dayofweek(created_time) IN (0, 6)",
)
def trace_filter_day_type(spark, sf):
    return s.on_day_type(view(spark, sf, "trace"), "weekend").select(
        "query_id", F.to_date("created_time").alias("day")
    )
