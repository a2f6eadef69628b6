"""Statistics, regressions, contention and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querytide.operators import contention as c
from querytide.operators import evaluate as ev
from querytide.operators import stats as s
from querytide.operators.overlap import valid_runs
from querytide.plans import features as pf
from querytide.registry.base import register, view
from querytide.registry.overlap import VALID, pairs_of, recent_of
from querytide.session import staged

LOOKBACK_US = 20_000_000
COUNTED = f"""{VALID}, {pairs_of('valid')},
counted AS (
  SELECT v.database_id, v.query_id, v.query_idx, v.start_us, v.run_us,
    count(CASE WHEN p.is_earlier THEN 1 END) AS n_prior, count(p.other_query_id) AS n_all
  FROM valid v LEFT JOIN pairs p ON p.query_id = v.query_id GROUP BY ALL),
isolated AS (SELECT query_idx, quantile_cont(run_us, 0.5) AS isolated_us FROM counted WHERE n_all = 0 GROUP BY 1),
averages AS (SELECT query_idx, avg(run_us) AS average_us FROM counted GROUP BY 1)"""
STATS = """stats AS (
  SELECT query_idx, avg(run_us) AS mean_us, stddev_pop(run_us) AS std_us, arg_max(run_us, (start_us, query_id)) AS latest_us,
    count(*) AS n, quantile_cont(run_us, 0.5) AS median_us FROM valid GROUP BY 1)"""

# Statistics of one engine's runs, by which those of all are predicted.
LEARNED = STATS.replace("stats AS", "learned AS").replace("FROM valid", "FROM valid WHERE engine = 'postgres'")


def rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def single(df, *names):
    """Doubles in single precision: no decimal value lies on its rounding borders, so the two
    engines agree although their last digits differ."""
    return df.withColumns({n: F.col(n).cast("float").cast("double") for n in names})


def valid(spark, sf):
    return valid_runs(view(spark, sf, "trace"))


def learned(spark, sf):
    return valid(spark, sf).where("engine = 'postgres'")


def counted(spark, sf):
    """Neighbour counts, written once: isolated runtimes and models both read them."""
    return staged(s.neighbour_counts(view(spark, sf, "trace")), "counted")


@register(
    "stat_query_runtime", "trace",
    "SELECT query_idx, round(mean_us, 3) AS mean_us, round(std_us, 3) AS std_us, latest_us, n, round(median_us, 3) AS median_us FROM stats",
    f"{VALID}, {STATS}",
)
def stat_query_runtime(spark, sf):
    return rounded(s.query_runtimes(valid(spark, sf)), 3, "mean_us", "std_us", "median_us")


@register(
    "stat_runtime_merge", "trace",
    "SELECT query_idx, round(mean_us, 3) AS mean_us, round(std_us, 3) AS std_us, latest_us, n FROM stats", f"{VALID}, {STATS}",
)
def stat_runtime_merge(spark, sf):
    runs = valid(spark, sf)
    old, new = runs.where("engine = 'postgres'"), runs.where("engine = 'redshift'")
    merged = s.merge_moments(s.runtime_moments(old), s.runtime_moments(new))
    return rounded(s.moments_to_statistics(merged), 3, "mean_us", "std_us")


@register(
    "stat_predict_cached", "trace",
    """SELECT query_id, round((median_us * 0.7 + latest_us * (1 - 0.7)) / 1000000, 6) AS cached_s
FROM trace LEFT JOIN learned USING (query_idx)""",
    f"{VALID}, {LEARNED}",
)
def stat_predict_cached(spark, sf):
    known = s.query_runtimes(learned(spark, sf))
    predicted = s.predict_cached(view(spark, sf, "trace"), known, alpha=0.7, use_median=True)
    return rounded(predicted.select("query_id", "cached_s"), 6, "cached_s")


def _features(spark, sf):
    """A small feature array per query: sums over its plan."""
    return view(spark, sf, "plan_nodes").groupBy("query_idx").agg(
        F.array(F.count(F.lit(1)).cast("double"), (F.sum("est_card") / 1e6)).alias("features")
    )


@register("stat_predict_feature_hash")
def stat_predict_feature_hash(spark, sf):
    keyed = view(spark, sf, "trace").join(_features(spark, sf), "query_idx")
    keyed = keyed.withColumn("key", s.feature_hash(F.col("features"), bits=6))
    known = s.query_runtimes(valid_runs(keyed), "key")
    return s.predict_cached(keyed, known, key="key").select("query_id", "key", "cached_s")


@register(
    "stat_predict_staged", "trace plan_nodes",
    """SELECT query_id, round(prediction, 6) AS prediction_s, list_transform([prediction, f1, f2], lambda x: round(x, 6)) AS online
FROM (SELECT query_id, f1, f2, coalesce(mean_us / 1000000, greatest(0.5 * f1 - 3 * f2, 0.01)) AS prediction
  FROM trace JOIN feats USING (query_idx) LEFT JOIN learned USING (query_idx))""",
    f"{VALID}, {LEARNED}, feats AS (SELECT query_idx, count(*)::DOUBLE AS f1, sum(est_card) / 1e6 AS f2 FROM plan_nodes GROUP BY 1)",
)
def stat_predict_staged(spark, sf):
    known = s.query_runtimes(learned(spark, sf))
    model = 0.5 * F.get("features", F.lit(0)) - 3 * F.get("features", F.lit(1))
    staged_rows = s.predict_staged(view(spark, sf, "trace"), known, _features(spark, sf), model)
    return staged_rows.select(
        "query_id", F.round("prediction_s", 6).alias("prediction_s"),
        F.transform("online", lambda x: F.round(x, 6)).alias("online"),
    )


@register("stat_isolated_runtime", "trace", "SELECT query_idx, round(isolated_us, 3) AS isolated_us FROM isolated", COUNTED)
def stat_isolated_runtime(spark, sf):
    return rounded(s.isolated_runtime(counted(spark, sf)), 3, "isolated_us")


@register("stat_average_runtime", "trace", "SELECT query_idx, round(average_us, 3) AS average_us FROM averages", COUNTED)
def stat_average_runtime(spark, sf):
    return rounded(s.average_runtime(counted(spark, sf)), 3, "average_us")


LINES = """slow AS (SELECT query_idx, n_prior::DOUBLE AS x, run_us / isolated_us AS y FROM counted JOIN isolated USING (query_idx) WHERE n_all > 0),
lines AS (SELECT query_idx, CASE WHEN max(x) > min(x) THEN regr_slope(y, x) ELSE 0 END AS slope,
  CASE WHEN max(x) > min(x) THEN regr_intercept(y, x) ELSE avg(y) END AS intercept FROM slow GROUP BY 1),
line AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM slow)"""


def _fitted(spark, sf):
    rows = counted(spark, sf)
    return rows, staged(s.isolated_runtime(rows), "isolated")


@register(
    "fit_slowdown_per_query", "trace",
    "SELECT query_idx, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM lines", f"{COUNTED}, {LINES}",
)
def fit_slowdown_per_query(spark, sf):
    return rounded(s.fit_slowdown(*_fitted(spark, sf)), 6, "slope", "intercept")


@register(
    "fit_slowdown_global", "trace", "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM line",
    f"{COUNTED}, {LINES}",
)
def fit_slowdown_global(spark, sf):
    return rounded(s.fit_slowdown(*_fitted(spark, sf), per_query=False), 6, "slope", "intercept")


@register(
    "predict_slowdown", "trace",
    """SELECT query_id, query_idx, greatest((n_prior * slope + intercept) * isolated_us / 1000000, 0.001)::FLOAT::DOUBLE AS prediction_s,
  run_us / 1000000 AS label_s FROM counted JOIN isolated USING (query_idx) JOIN lines USING (query_idx)""",
    f"{COUNTED}, {LINES}",
)
def predict_slowdown(spark, sf):
    rows, isolated = _fitted(spark, sf)
    return single(s.predict_slowdown(rows, isolated, s.fit_slowdown(rows, isolated)), "prediction_s")


@register(
    "predict_slowdown_global", "trace",
    """SELECT query_id, query_idx, greatest((n_prior * slope + intercept) * isolated_us / 1000000, 0.001)::FLOAT::DOUBLE AS prediction_s,
  run_us / 1000000 AS label_s FROM counted JOIN isolated USING (query_idx), line""",
    f"{COUNTED}, {LINES}",
)
def predict_slowdown_global(spark, sf):
    rows, isolated = _fitted(spark, sf)
    line = s.fit_slowdown(rows, isolated, per_query=False)
    return single(s.predict_slowdown(rows, isolated, line, per_query=False), "prediction_s")


@register(
    "predict_naive", "trace",
    """SELECT query_id, query_idx, round(isolated_us / 1000000, 6) AS prediction_s, run_us / 1000000 AS label_s
FROM counted JOIN isolated USING (query_idx)""",
    COUNTED,
)
def predict_naive(spark, sf):
    return rounded(s.predict_naive(*_fitted(spark, sf)), 6, "prediction_s")


CURVES = """per_n AS (
  SELECT query_idx, n_prior::DOUBLE AS n, isolated_us / 1000000 AS iso, count(*) AS c, sum((run_us - isolated_us) / 1000000) AS z,
    sum(pow((run_us - isolated_us) / 1000000, 2)) AS zz FROM counted JOIN isolated USING (query_idx) WHERE n_all > 0 GROUP BY 1, 2, 3),
eligible AS (SELECT * FROM per_n WHERE query_idx IN (SELECT query_idx FROM per_n GROUP BY 1 HAVING sum(c) >= 10)),
sums AS (
  SELECT {key} b1, sum(c * u * u) AS uu, sum(c * u * v) AS uv, sum(c * v * v) AS vv, sum(u * z) AS uz, sum(v * z) AS vz, sum(zz) AS zz
  FROM (SELECT *, greatest(n - b1, 0) AS u, least(n, b1) * iso AS v FROM eligible, (SELECT unnest(range(1, (SELECT max(n)::BIGINT + 1 FROM per_n)))::DOUBLE AS b1)) GROUP BY ALL),
solved AS (SELECT *, (uz * vv - vz * uv) / (uu * vv - uv * uv) AS a1, (vz * uu - uz * uv) / (uu * vv - uv * uv) AS a2
  FROM sums WHERE uu * vv - uv * uv > 1e-9 * uu * vv),
curves AS (SELECT {key} unnest(arg_min({'a1': a1, 'a2': a2, 'b1': b1}, (round(zz - a1 * uz - a2 * vz, 4), b1))) FROM solved {group})"""


def curves(per_query: bool) -> str:
    key, group = ("query_idx,", "GROUP BY query_idx") if per_query else ("", "")
    return f"{COUNTED}, " + CURVES.replace("{key}", key).replace("{group}", group)


@register(
    "fit_queueing_curve", "trace",
    "SELECT query_idx, round(a1, 4) AS a1, round(a2, 4) AS a2, b1 FROM curves", curves(True),
)
def fit_queueing_curve(spark, sf):
    return rounded(s.fit_queueing_curve(*_fitted(spark, sf)), 4, "a1", "a2")


@register("fit_queueing_curve_global", "trace", "SELECT round(a1, 4) AS a1, round(a2, 4) AS a2, b1 FROM curves", curves(False))
def fit_queueing_curve_global(spark, sf):
    return rounded(s.fit_queueing_curve(*_fitted(spark, sf), per_query=False), 4, "a1", "a2")


@register(
    "predict_queueing_curve", "trace",
    """SELECT query_id, query_idx, round(greatest(a1 * greatest(n_prior - b1, 0) + (1 + a2 * least(n_prior, b1)) * isolated_us / 1000000,
  0.001), 3) AS prediction_s, run_us / 1000000 AS label_s FROM counted JOIN isolated USING (query_idx) JOIN curves USING (query_idx)""",
    curves(True),
)
def predict_queueing_curve(spark, sf):
    rows, isolated = _fitted(spark, sf)
    fitted = s.fit_queueing_curve(rows, isolated)
    return rounded(s.predict_queueing_curve(rows, isolated, fitted), 3, "prediction_s")


SCANS = """widths AS (SELECT tablename AS table_name, sum(avg_width) AS w FROM column_stats GROUP BY 1),
scans AS (SELECT query_idx, table_name, sum(est_card * w) / 1048576 AS scan_mb FROM plan_nodes JOIN widths USING (table_name) GROUP BY 1, 2),
sizes AS (SELECT relname AS table_name, reltuples * w / 1048576 AS size_mb FROM table_stats JOIN (
  SELECT tablename AS relname, sum(CASE WHEN avg_width > 0 THEN avg_width ELSE 0 END) AS w FROM column_stats GROUP BY 1) USING (relname))"""
# Weights enter sums with twelve decimals on both sides.
SHARING = """near AS ({near}),
parts AS (
  SELECT v.query_id, o.table_name, any_value(o.scan_mb) AS own, coalesce(sum(CAST(t.scan_mb / z.size_mb AS DECIMAL(30,12))), 0)::DOUBLE AS f
  FROM valid v JOIN scans o ON o.query_idx = v.query_idx JOIN sizes z ON z.table_name = o.table_name
  LEFT JOIN near n ON n.query_id = v.query_id LEFT JOIN valid b ON b.query_id = n.other_query_id
  LEFT JOIN scans t ON t.query_idx = b.query_idx AND t.table_name = o.table_name
  GROUP BY 1, 2),
sharing AS (SELECT query_id, least(sum(least(f * own, own)) / sum(own), 1) AS sharing FROM parts GROUP BY 1)"""
BOTH = "SELECT query_id, other_query_id FROM pairs UNION ALL SELECT query_id, other_query_id FROM recent"
PRIOR = "SELECT query_id, other_query_id FROM pairs WHERE is_earlier UNION ALL SELECT query_id, other_query_id FROM recent"
PROFILES = """prof AS (
  SELECT query_idx, isolated_us / 1000000 AS isolated_s, average_us / 1000000 AS average_s, scan_mb, max_card, sum_card, n_card
  FROM averages LEFT JOIN isolated USING (query_idx)
  LEFT JOIN (SELECT query_idx, max(est_card * est_width) / 1048576 AS max_card, sum(est_card * est_width) / 1048576 AS sum_card,
    count(*) AS n_card FROM plan_nodes GROUP BY 1) USING (query_idx)
  LEFT JOIN (SELECT query_idx, sum(scan_mb) AS scan_mb FROM scans GROUP BY 1) USING (query_idx))"""
VIEWS = "trace plan_nodes table_stats column_stats"


def contention_ctes(near: str) -> str:
    return f"{COUNTED}, {recent_of('valid', LOOKBACK_US)}, {SCANS}, {SHARING.replace('{near}', near)}, {PROFILES}"


def _inputs(spark, sf):
    """Runs, profiles, scans and table sizes."""
    nodes, columns, tables = (view(spark, sf, n) for n in ("plan_nodes", "column_stats", "table_stats"))
    rows = counted(spark, sf)
    scans = pf.scan_mb(nodes, columns)
    cards = pf.cardinalities(nodes, with_width=True)
    profiles = staged(c.query_profiles(s.isolated_runtime(rows), s.average_runtime(rows), cards, scans), "profiles")
    return rows.drop("n_prior", "n_all"), profiles, staged(scans, "scans"), pf.table_sizes(columns, tables)


# Sizes in MB are binary fractions, which can lie just on a rounding border, so a little is added first. Weights with twelve decimals
# differ in the last one between the engines; their sums are compared to three.
AWAY = 1e-9


def _away_sql(names):
    return ", ".join(f"round({n} + {AWAY}, 3) AS {n}" for n in names)


def _away(df, digits, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double") + AWAY, digits) for n in names})


@register(
    "contention_data_sharing", VIEWS, f"SELECT query_id, round(sharing + {AWAY}, 6) AS sharing FROM sharing", contention_ctes(BOTH)
)
def contention_data_sharing(spark, sf):
    runs, _, scans, sizes = _inputs(spark, sf)
    return _away(c.data_sharing(runs, scans, sizes, lookback_us=LOOKBACK_US), 6, "sharing")


def _weight(name: str) -> str:
    return f"CAST(b.{name} AS DECIMAL(30,12))"


def _sum(name: str, side: str = "") -> str:
    value = f"CASE WHEN {side} THEN {_weight(name)} END" if side else _weight(name)
    return f"coalesce(sum({value}), 0)::DOUBLE"


FEATURES = f"""raw AS (
  SELECT v.query_id, v.query_idx, v.run_us / 1000000 AS label_s, count(*)::DOUBLE AS n,
    {_sum('average_s')} AS sum_neighbour_s, {_sum('scan_mb')} AS neighbour_scan_mb,
    coalesce(max(b.max_card), 0) AS neighbour_max_card, {_sum('sum_card * 1048576')} / {_sum('n_card')} / 1048576 AS neighbour_avg_card
  FROM valid v JOIN pairs p ON p.query_id = v.query_id JOIN valid w ON w.query_id = p.other_query_id
  LEFT JOIN prof b ON b.query_idx = w.query_idx GROUP BY 1, 2, 3),
feats AS (
  SELECT r.query_id, r.query_idx, r.label_s, isolated_s, average_s, n, sum_neighbour_s, scan_mb, neighbour_scan_mb,
    coalesce(sharing, 0) AS sharing, max_card, sum_card / n_card AS avg_card, neighbour_max_card, neighbour_avg_card
  FROM raw r JOIN prof USING (query_idx) LEFT JOIN sharing USING (query_id)
  WHERE isolated_s IS NOT NULL AND scan_mb IS NOT NULL AND n_card IS NOT NULL)"""


@register(
    "contention_features", VIEWS,
    f"SELECT query_id, query_idx, label_s, {_away_sql(c.CONTENTION_COLUMNS)} FROM feats", f"{contention_ctes(BOTH)}, {FEATURES}",
)
def contention_features(spark, sf):
    return _away(c.contention_features(*_inputs(spark, sf), lookback_us=LOOKBACK_US), 3, *c.CONTENTION_COLUMNS)


SPLIT = f"""raw AS (
  SELECT v.query_id, v.query_idx, v.run_us / 1000000 AS label_s,
    count(CASE WHEN is_earlier THEN 1 END)::DOUBLE AS n_pre, count(CASE WHEN NOT is_earlier THEN 1 END)::DOUBLE AS n_post,
    {_sum('average_s', 'is_earlier')} AS sum_s_pre, {_sum('average_s', 'NOT is_earlier')} AS sum_s_post,
    coalesce(sum(CASE WHEN is_earlier THEN v.start_us - w.start_us END), 0) / 1000000 / (count(CASE WHEN is_earlier THEN 1 END) + 0.001) AS avg_elapsed_pre,
    coalesce(sum(CASE WHEN NOT is_earlier THEN least(v.start_us + v.run_us, w.start_us + w.run_us) - w.start_us END), 0) / 1000000 AS sum_overlap_post,
    {_sum('scan_mb', 'is_earlier')} AS scan_pre, {_sum('scan_mb', 'NOT is_earlier')} AS scan_post,
    coalesce(max(CASE WHEN is_earlier THEN b.max_card END), 0) AS max_card_pre,
    coalesce(max(CASE WHEN NOT is_earlier THEN b.max_card END), 0) AS max_card_post,
    coalesce({_sum('sum_card * 1048576', 'is_earlier')} / nullif({_sum('n_card', 'is_earlier')}, 0) / 1048576, 0) AS avg_card_pre,
    coalesce({_sum('sum_card * 1048576', 'NOT is_earlier')} / nullif({_sum('n_card', 'NOT is_earlier')}, 0) / 1048576, 0) AS avg_card_post
  FROM valid v JOIN pairs p ON p.query_id = v.query_id JOIN valid w ON w.query_id = p.other_query_id
  LEFT JOIN prof b ON b.query_idx = w.query_idx GROUP BY 1, 2, 3, v.start_us),
feats AS (
  SELECT r.*, isolated_s, average_s, scan_mb, coalesce(sharing, 0) AS sharing, max_card, sum_card / n_card AS avg_card
  FROM raw r JOIN prof USING (query_idx) LEFT JOIN sharing USING (query_id)
  WHERE isolated_s IS NOT NULL AND scan_mb IS NOT NULL AND n_card IS NOT NULL)"""


@register(
    "contention_features_split", VIEWS,
    f"SELECT query_id, query_idx, label_s, {_away_sql(c.SPLIT_COLUMNS)} FROM feats", f"{contention_ctes(PRIOR)}, {SPLIT}",
)
def contention_features_split(spark, sf):
    return _away(c.contention_features_split(*_inputs(spark, sf), lookback_us=LOOKBACK_US), 3, *c.SPLIT_COLUMNS)


SCORE = """scored AS (SELECT query_id, label_s, greatest(
  0.5 * greatest(n - 10, 0) / greatest(n, 1) * sum_neighbour_s + io + (0.8 * isolated_s + 0.2 * average_s - io) * (
    1 + 0.2 * cpu + 0.1 * mem + 0.2 * sqrt(cpu * mem)), 0.01) AS score
FROM (SELECT *, 2 * scan_mb * (1 - sharing) / (20 + 200 / least(greatest(n, 1), 10)) AS io,
  least(n, 10) / greatest(n, 1) * sum_neighbour_s / average_s AS cpu,
  greatest(ln(0.5 * greatest(neighbour_max_card + max_card - 16000, 0.01) * neighbour_max_card / (neighbour_max_card + max_card)
    + 0.5 * greatest(neighbour_avg_card + avg_card - 16000, 0.01) * neighbour_avg_card / (neighbour_avg_card + avg_card) + 0.0001)
    * ln(0.5 * max_card + 0.5 * avg_card + 0.0001), 0) AS mem FROM feats))"""


@register(
    "contention_score", VIEWS, "SELECT query_id, label_s, round(score, 4) AS score FROM scored",
    f"{contention_ctes(BOTH)}, {FEATURES}, {SCORE}",
)
def contention_score(spark, sf):
    rows = c.contention_features(*_inputs(spark, sf), lookback_us=LOOKBACK_US)
    return rows.select("query_id", "label_s", F.round(c.contention_score(), 4).alias("score"))


SPLIT_COMMON = """common AS (SELECT *, greatest(left_s * run_f / greatest(sum_s_pre, 0.1), {least}) AS dpre,
    greatest(0.5 * greatest(n_pre + 0.3 * n_post - 10, 0) / greatest(n_pre + 0.3 * n_post, 1) * (left_s + 0.3 * sum_s_post), 0) AS queue,
    sum_overlap_post / greatest(sum_s_post, 0.1) AS dpost
  FROM (SELECT *, least(n_pre + n_post, 10) / greatest(n_pre + n_post, 1) AS run_f, sum_s_pre - avg_elapsed_pre * n_pre AS left_s FROM feats)),
speeds AS (SELECT *, 20 + 200 / least(greatest(n_pre * dpre + 0.3 * n_post * dpost, 1), 10) AS speed FROM common)"""
SPLIT_SCORE = """scored AS (SELECT query_id, label_s, greatest(queue + io + alone * (1 + 0.2 * (cpre + 0.9 * cpost) * (
    1 + 0.1 * mem + 0.2 * sqrt((cpre + cpost) * mem))), 0.01) AS score
  FROM (SELECT *, greatest(0.5 * isolated_s + 0.5 * average_s - io, 0.1) AS alone FROM (SELECT *,
    2 * scan_mb * (1 - sharing * run_f) / speed AS io, sum_s_pre * dpre / average_s AS cpre, sum_overlap_post / average_s AS cpost,
    (0.3 * 0.3 * (greatest(max_card_pre + max_card - 16000, 0.01) * max_card / (max_card_pre + max_card)
      + greatest(max_card_post + max_card - 16000, 0.01) * max_card / (max_card_post + max_card))
    + 0.3 * 0.3 * (greatest(avg_card_pre + avg_card - 16000, 0.01) * avg_card / (avg_card_pre + avg_card)
      + greatest(avg_card_post + avg_card - 16000, 0.01) * avg_card / (avg_card_post + avg_card))) / 16000 AS mem FROM speeds)))"""
SPLIT_SCORE_V2 = """scored AS (SELECT query_id, label_s, greatest(queue + io + alone * (1 + 0.2 * (cpre + 0.9 * cpost) * (
    1 + mem + 0.2 * sqrt((cpre + cpost) * mem))), 0.01) AS score
  FROM (SELECT *, greatest(0.5 * isolated_s + 0.5 * average_s - plain, 0.1) AS alone,
    plain * greatest(1 - sharing * run_f, 0) AS io FROM (SELECT *, 2 * scan_mb / speed AS plain,
    sum_s_pre * dpre / greatest(average_s, 2) AS cpre, sum_overlap_post / greatest(average_s, 2) AS cpost,
    0.3 * sqrt((greatest(0.3 * (max_card_pre + max_card) - {mem}, 0) * max_card / (max_card_pre + max_card)
      + greatest(0.3 * (max_card_post + max_card) - {mem}, 0) * max_card / (max_card_post + max_card)) / {mem})
    + 0.3 * sqrt((greatest(0.3 * (avg_card_pre + avg_card) - {mem}, 0) * avg_card / (avg_card_pre + avg_card)
      + greatest(0.3 * (avg_card_post + avg_card) - {mem}, 0) * avg_card / (avg_card_post + avg_card)) / {mem}) AS mem FROM speeds)))"""


@register(
    "contention_score_split", VIEWS, "SELECT query_id, label_s, round(score, 4) AS score FROM scored",
    f"{contention_ctes(PRIOR)}, {SPLIT}, {SPLIT_COMMON.replace('{least}', '0')}, {SPLIT_SCORE}",
)
def contention_score_split(spark, sf):
    rows = c.contention_features_split(*_inputs(spark, sf), lookback_us=LOOKBACK_US)
    return rows.select("query_id", "label_s", F.round(c.contention_score_split(), 4).alias("score"))


@register(
    "contention_score_split_v2", VIEWS, "SELECT query_id, label_s, round(score, 4) AS score FROM scored",
    f"{contention_ctes(PRIOR)}, {SPLIT}, {SPLIT_COMMON.replace('{least}', '0.1')}, {SPLIT_SCORE_V2.replace('{mem}', '5')}",
)
def contention_score_split_v2(spark, sf):
    rows = c.contention_features_split(*_inputs(spark, sf), lookback_us=LOOKBACK_US)
    # A small memory, so that the pressure terms matter on this data.
    return rows.select("query_id", "label_s", F.round(c.contention_score_split_v2({"memory_size": 5}), 4).alias("score"))


def _predictions(spark, sf):
    rows, isolated = _fitted(spark, sf)
    return staged(s.predict_naive(rows, isolated), "predictions")


PREDICTED = f"""{COUNTED}, preds AS (SELECT query_id, query_idx, isolated_us / 1000000 AS p, run_us / 1000000 AS l
  FROM counted JOIN isolated USING (query_idx)),
errs AS (SELECT *, 'absolute' AS measure, abs(p - l) AS m FROM preds UNION ALL SELECT *, 'q', greatest(p / l, l / p) FROM preds)"""


def _summary(keys: str, src: str, probs=("50", "90", "95")) -> str:
    parts = ", ".join(f"round(quantile_cont(m, {int(q) / 100}), 6) AS p{q}" for q in probs)
    return f"SELECT {keys} count(m) AS n, avg(m)::FLOAT::DOUBLE AS mean, {parts} FROM {src} GROUP BY ALL"


def _report(df, *more):
    return single(rounded(df, 6, "p50", "p90", *more), "mean")


@register("eval_overall", "trace", _summary("measure,", "errs"), PREDICTED)
def eval_overall(spark, sf):
    return _report(ev.overall(_predictions(spark, sf)), "p95")


@register("eval_per_query", "trace", _summary("query_idx, measure,", "errs"), PREDICTED)
def eval_per_query(spark, sf):
    return _report(ev.per_query(_predictions(spark, sf)), "p95")


@register(
    "eval_by_runtime_interval", "trace", _summary("interval, measure,", "placed", ("50", "90", "95", "99")),
    PREDICTED + """, placed AS (SELECT errs.*, CASE WHEN m2 < 30 THEN 0 WHEN m2 < 50 THEN 1 ELSE 2 END::INT AS interval FROM errs JOIN (
  SELECT query_idx, quantile_cont(l, 0.5) AS m2 FROM preds GROUP BY 1) USING (query_idx))""",
)
def eval_by_runtime_interval(spark, sf):
    return _report(ev.by_runtime_interval(_predictions(spark, sf), [0, 30, 50]), "p95", "p99")


@register(
    "eval_by_template", "trace",
    _summary("template, measure,", "(SELECT *, query_idx % 22 + 1 AS template FROM errs WHERE measure = 'q')", ("50", "90", "99")),
    PREDICTED,
)
def eval_by_template(spark, sf):
    templates = view(spark, sf, "trace").select("query_idx", (F.col("query_idx") % 22 + 1).alias("template")).distinct()
    return _report(ev.by_template(_predictions(spark, sf), templates), "p99")


@register(
    "eval_q_loss", "trace",
    """SELECT round(avg(CASE WHEN p < 2 THEN (1 - p) * 10 WHEN p < 30 AND l < 30 THEN abs(l - p) * 0.1
  ELSE abs(ln(p) - ln(l)) END), 6) AS q_loss FROM preds""",
    PREDICTED,
)
def eval_q_loss(spark, sf):
    loss = ev.q_loss(F.col("prediction_s"), F.col("label_s"), least=2, short=30, below_least=10)
    return _predictions(spark, sf).agg(F.round(F.avg(loss), 6).alias("q_loss"))


DONE = "done AS (SELECT * FROM result_log WHERE exec_us >= 0 AND e2e_us >= 0)"
ALL4 = ("50", "90", "95", "99")


@register(
    "report_latency", "result_log",
    _summary("measure,", "(SELECT 'exec_us' AS measure, exec_us::DOUBLE AS m FROM done UNION ALL SELECT 'e2e_us', e2e_us FROM done)", ALL4),
    DONE,
)
def report_latency(spark, sf):
    return _report(ev.latency(view(spark, sf, "result_log")), "p95", "p99")


@register(
    "report_queueing", "result_log",
    _summary("measure,", "(SELECT 'queueing_us' AS measure, greatest(e2e_us - exec_us, 0)::DOUBLE AS m FROM done)", ALL4), DONE,
)
def report_queueing(spark, sf):
    return _report(ev.queueing(view(spark, sf, "result_log")), "p95", "p99")


@register(
    "report_compare_runs", "result_log",
    _summary("measure,", """(SELECT 'baseline_us' AS measure, a::DOUBLE AS m FROM bothr UNION ALL SELECT 'other_us', b FROM bothr
  UNION ALL SELECT 'difference_us', b - a FROM bothr UNION ALL SELECT 'ratio', CASE WHEN a > 0 THEN b / a END FROM bothr)""", ALL4),
    f"{DONE}, bothr AS (SELECT e2e_us AS a, e2e_us - e2e_us * (query_idx % 9) // 20 AS b FROM done)",
)
def report_compare_runs(spark, sf):
    log = view(spark, sf, "result_log")
    other = log.withColumn("e2e_us", F.expr("e2e_us - e2e_us * (query_idx % 9) div 20"))
    return _report(ev.compare_runs(log, other), "p95", "p99")
