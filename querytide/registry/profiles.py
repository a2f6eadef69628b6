"""Concurrency profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querytide.operators import profiles as p
from querytide.registry.base import register, view
from querytide.registry.overlap import pairs_of

# Concurrency inside one day, on the wide trace.
DAILY = """daily AS (
  SELECT query_id, database_id, CAST(created_time AS DATE) AS date, epoch_us(created_time) AS s,
    epoch_us(created_time) + run_us AS e FROM {src}),
near AS (
  SELECT a.query_id, a.database_id, a.date, a.s, (SELECT count(*) FROM daily b WHERE {same} b.date = a.date
    AND ((b.s, b.query_id) < (a.s, a.query_id) AND b.e > a.s OR (b.s, b.query_id) > (a.s, a.query_id) AND b.s < a.e)) AS n
  FROM daily a),
found AS (
  SELECT {db} date, s // 1000000 % 86400 // 600 * 600 AS bucket_s, count(*) AS n_queries, avg(n) AS mean_concurrent
  FROM near GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily),
  INTERVAL 1 DAY)) AS DATE) AS date),
slots AS (SELECT unnest(range(0, 86400, 600)) AS bucket_s),
grid AS (
  SELECT {gdb} date, bucket_s, coalesce(n_queries, 0) AS n_queries, coalesce(mean_concurrent, 0) AS mean_concurrent,
    lpad(CAST(bucket_s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(bucket_s % 3600 // 60 AS VARCHAR), 2, '0') || ':00' AS bucket
  FROM {dbs} days CROSS JOIN slots LEFT JOIN found USING ({udb} date, bucket_s))"""


def daily(per_database: bool, src: str = "trace") -> str:
    words = (
        {"same": "b.database_id = a.database_id AND", "db": "database_id,", "gdb": "database_id,", "udb": "database_id,",
         "dbs": "(SELECT DISTINCT database_id FROM daily) CROSS JOIN"}
        if per_database
        else {"same": "", "db": "", "gdb": "", "udb": "", "dbs": ""}
    )
    sql = DAILY.replace("{src}", src)
    for key, word in words.items():
        sql = sql.replace("{" + key + "}", word)
    return sql


@register(
    "prof_interval", "trace",
    "SELECT date, bucket, n_queries, round(mean_concurrent, 6) AS mean_concurrent FROM grid", daily(False),
)
def prof_interval(spark, sf):
    profile = p.interval_profile(view(spark, sf, "trace"))
    return profile.select("date", "bucket", "n_queries", F.round("mean_concurrent", 6).alias("mean_concurrent"))


AVERAGE = """round(avg(n_queries), 6) AS n_queries, round(avg(mean_concurrent), 6) AS mean_concurrent"""


@register("prof_interval_avg_days", "trace", f"SELECT bucket, {AVERAGE} FROM grid GROUP BY 1", daily(False))
def prof_interval_avg_days(spark, sf):
    return _rounded(p.average_days(p.interval_profile(view(spark, sf, "trace"))))


def _rounded(profile):
    return profile.withColumns({c: F.round(c, 6) for c in ("n_queries", "mean_concurrent")})


@register(
    "prof_interval_avg_databases", "trace",
    f"""SELECT bucket, {AVERAGE} FROM (
  SELECT database_id, bucket, avg(n_queries) AS n_queries, avg(mean_concurrent) AS mean_concurrent
  FROM grid GROUP BY 1, 2) GROUP BY 1""",
    "kept AS (SELECT * FROM trace WHERE database_id IN (SELECT database_id FROM trace GROUP BY 1 HAVING count(*) > 100 "
    ")), " + daily(True, "kept"),
)
def prof_interval_avg_databases(spark, sf):
    return _rounded(p.average_databases(view(spark, sf, "trace"), min_queries=100))


@register(
    "prof_interval_single_day", "trace",
    """SELECT lpad(CAST(b // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b % 3600 // 60 AS VARCHAR), 2, '0') || ':00' AS bucket,
  coalesce(n_queries, 0) AS n_queries, round(coalesce(mean_concurrent, 0), 6) AS mean_concurrent
FROM (SELECT unnest(range(0, 86400, 600)) AS b) LEFT JOIN (
  SELECT start_us // 1000000 // 600 * 600 AS b, count(*) AS n_queries, avg(n) AS mean_concurrent
  FROM near GROUP BY 1) USING (b)""",
    """near AS (SELECT a.query_id, a.start_us, (SELECT count(*) FROM trace b WHERE
    (b.start_us, b.query_id) < (a.start_us, a.query_id) AND b.start_us + b.run_us > a.start_us
    OR (b.start_us, b.query_id) > (a.start_us, a.query_id) AND b.start_us < a.start_us + a.run_us) AS n FROM trace a)""",
)
def prof_interval_single_day(spark, sf):
    profile = p.single_day_profile(view(spark, sf, "trace"))
    return profile.select("bucket", "n_queries", F.round("mean_concurrent", 6).alias("mean_concurrent"))


@register(
    "prof_runtime_histogram", "trace",
    """SELECT b.bin, coalesce(n, 0) AS n, round((lo + b.bin * (hi - lo) / 100) / 1000000, 6) AS low_s,
  round((lo + (b.bin + 1) * (hi - lo) / 100) / 1000000, 6) AS high_s
FROM (SELECT CAST(unnest(range(100)) AS INT) AS bin) b CROSS JOIN lim LEFT JOIN (
  SELECT CAST(least((run_us - lo) * 100 // (hi - lo), 99) AS INT) AS bin, count(*) AS n FROM kept, lim GROUP BY 1) c USING (bin)""",
    """kept AS (SELECT run_us FROM trace WHERE run_us < 200000000),
lim AS (SELECT min(run_us) AS lo, max(run_us) AS hi FROM kept)""",
)
def prof_runtime_histogram(spark, sf):
    bins = p.runtime_histogram(view(spark, sf, "trace"), 200_000_000)
    return bins.withColumns({c: F.round(c, 6) for c in ("low_s", "high_s")})


@register(
    "prof_summary", "trace",
    """SELECT min(run_us) AS min_us, max(run_us) AS max_us, round(avg(run_us), 3) AS mean_us,
  round(quantile_cont(run_us, 0.5), 3) AS median_us FROM trace""",
)
def prof_summary(spark, sf):
    return p.runtime_summary(view(spark, sf, "trace")).withColumns(
        {c: F.round(F.col(c).cast("double"), 3) for c in ("mean_us", "median_us")}
    )


@register(
    "prof_running_load", "trace",
    """SELECT t.database_id, t.query_id, CAST(coalesce(sum(b.query_idx * 7 % 50 + 1), 0) AS DOUBLE) AS load,
  coalesce(sum(b.query_idx * 7 % 50 + 1), 0) + any_value(t.query_idx) * 7 % 50 + 1 <= 300 AS fits
FROM trace t LEFT JOIN pairs p ON p.query_id = t.query_id AND p.is_earlier LEFT JOIN trace b ON b.query_id = p.other_query_id
GROUP BY 1, 2""",
    pairs_of("trace"),
)
def prof_running_load(spark, sf):
    return p.running_load(view(spark, sf, "trace"), F.col("query_idx") * 7 % 50 + 1, 300)


@register(
    "prof_starvation_top_k", "trace",
    """SELECT snapshot_us, place, query_id, round(score, 3) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_us ORDER BY score DESC, query_id) AS INT) AS place FROM (
    SELECT query_id, k * 30000000 AS snapshot_us, (k * 30000000 - enter_us) / 1000000 * 0.5 + estimate AS score FROM (
      SELECT *, unnest(range(CAST(ceil(enter_us / 30000000) AS BIGINT), CAST(ceil(leave_us / 30000000) AS BIGINT))) AS k FROM waiting)))
WHERE place <= 3""",
    """waiting AS (SELECT query_id, start_us AS enter_us, start_us + run_us // 10000 % 7 * 10000000 AS leave_us,
  query_idx * 7 % 50 + 1 AS estimate FROM trace)""",
)
def prof_starvation_top_k(spark, sf):
    waiting = view(spark, sf, "trace").select(
        "query_id",
        F.col("start_us").alias("enter_us"),
        F.expr("start_us + run_us div 10000 % 7 * 10000000").alias("leave_us"),
        (F.col("query_idx") * 7 % 50 + 1).alias("estimate"),
    )
    return p.starvation_top_k(waiting, 30_000_000, 0.5, 3).withColumn("score", F.round("score", 3))
