"""Neighbour vectors, clusters, mixes, sequences, graphs and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from querytide.operators import contention as c
from querytide.operators import graphs as g
from querytide.operators import learn as m
from querytide.operators import stats as s
from querytide.plans import explain as e
from querytide.plans import features as pf
from querytide.registry.base import register, view
from querytide.registry.overlap import pairs_of, recent_of
from querytide.registry.plans import PARENTS, operator_list
from querytide.registry.stats import COUNTED, LOOKBACK_US, _features, _fitted, _inputs, counted, rounded, valid
from querytide.session import staged

# Rounds and depth of the registered model fits, small enough for a check run.
SMALL = {"rounds": 4, "depth": 4}
CLUSTERS = 5

VECTORS = """busy AS (SELECT v.query_id, v.query_idx FROM valid v WHERE v.query_id IN (SELECT query_id FROM pairs)),
kept AS (SELECT query_id, query_idx, isolated_us / 1000000 AS iso FROM busy JOIN isolated USING (query_idx)
  WHERE query_idx IN (SELECT query_idx FROM busy GROUP BY 1 HAVING count(*) >= 2)),
near AS (SELECT query_id, other_query_id, 'neighbour' AS part FROM pairs WHERE is_earlier
  UNION ALL SELECT query_id, other_query_id, 'recent' FROM recent)"""


@register(
    "neighbor_vectors", "trace",
    """SELECT query_id, 'own' AS part, query_idx AS position, round(iso, 6) AS value FROM kept UNION ALL
SELECT k.query_id, n.part, b.query_idx, round(sum(coalesce(i.isolated_us / 1000000, 1)), 6)
FROM kept k JOIN near n ON n.query_id = k.query_id JOIN valid b ON b.query_id = n.other_query_id
LEFT JOIN isolated i ON i.query_idx = b.query_idx GROUP BY 1, 2, 3""",
    f"{COUNTED}, {recent_of('valid', LOOKBACK_US)}, {VECTORS}",
)
def neighbor_vectors(spark, sf):
    rows, isolated = _fitted(spark, sf)
    return rounded(m.neighbour_vectors(rows, isolated, lookback_us=LOOKBACK_US), 6, "value")


@register("fit_plan_gbt")
def fit_plan_gbt(spark, sf):
    features = pf.plan_features(view(spark, sf, "plan_nodes"), operator_list(spark, sf), with_width=True)
    rows = valid(spark, sf).join(features, "query_idx").select(
        "query_id", "query_idx", "features", (F.col("run_us") / 1e6).alias("label_s")
    )
    model = m.fit_gbt(rows, "features", "label_s", **SMALL)
    return m.predict_gbt(model, rows, "features", 0.01).select("query_id", "query_idx", "prediction_s", "label_s")


@register("fit_neighbor_gbt")
def fit_neighbor_gbt(spark, sf):
    rows, isolated = _fitted(spark, sf)
    width = rows.agg(F.max("query_idx")).first()[0] + 1
    dense = m.dense_vectors(m.neighbour_vectors(rows, isolated), width)
    labelled = dense.join(rows.select("query_id", "query_idx", (F.col("run_us") / 1e6).alias("label_s")), "query_id")
    labelled = staged(labelled, "vectors")
    model = m.fit_gbt(labelled, "features", "label_s", **SMALL)
    return m.predict_gbt(model, labelled, "features", 0.001).select("query_id", "query_idx", "prediction_s", "label_s")


@register("fit_contention_gbt")
def fit_contention_gbt(spark, sf):
    built = c.contention_features(*_inputs(spark, sf), lookback_us=LOOKBACK_US)
    rows = staged(built.select("query_id", "query_idx", "label_s", F.array(*c.CONTENTION_COLUMNS).alias("features")), "contention")
    model = m.fit_gbt(rows, "features", "label_s", **SMALL)
    return m.predict_gbt(model, rows, "features", 0.01).select("query_id", "query_idx", "prediction_s", "label_s")


def _templates(spark, sf):
    return view(spark, sf, "trace").select("query_idx", (F.col("query_idx") % 22 + 1).alias("template")).distinct()


@register("cluster_template", "trace", "SELECT query_id, query_idx, query_idx % 22 + 1 AS cluster FROM trace")
def cluster_template(spark, sf):
    return m.cluster_by_template(view(spark, sf, "trace"), _templates(spark, sf)).select("query_id", "query_idx", "cluster")


@register("cluster_kmeans")
def cluster_kmeans(spark, sf):
    known = s.query_runtimes(valid(spark, sf))
    rows = _features(spark, sf).join(known, "query_idx").select(
        "query_idx", F.concat(F.array(F.col("mean_us") / 1e6), "features").alias("features")
    )
    return m.cluster_kmeans(staged(rows, "cluster"), 10)


@register(
    "cluster_kmeans_small", "plan_nodes",
    "SELECT DISTINCT query_idx, CAST(dense_rank() OVER (ORDER BY query_idx) - 1 AS INT) AS cluster FROM plan_nodes",
)
def cluster_kmeans_small(spark, sf):
    return m.cluster_each(_features(spark, sf))


def _clusters(spark, sf):
    return view(spark, sf, "trace").select("query_idx", (F.col("query_idx") % CLUSTERS).alias("cluster")).distinct()


def _mixes(spark, sf):
    return m.mix_vectors(valid(spark, sf), _clusters(spark, sf), CLUSTERS)


MIXES = f"""mixes AS (
  SELECT v.query_id, v.query_idx, v.query_idx % {CLUSTERS} AS cluster, v.run_us, [{', '.join(
    f"count(CASE WHEN b.query_idx % {CLUSTERS} = {i} THEN 1 END) + CASE WHEN v.query_idx % {CLUSTERS} = {i} THEN 1 ELSE 0 END"
    for i in range(CLUSTERS))}] AS mix
  FROM valid v LEFT JOIN pairs p ON p.query_id = v.query_id LEFT JOIN valid b ON b.query_id = p.other_query_id
  GROUP BY v.query_id, v.query_idx, v.run_us),
means AS (SELECT cluster, avg(run_us) / 1000000 AS mean_s FROM mixes GROUP BY 1)"""


@register("mix_vectors", "trace", "SELECT query_id, cluster, mix FROM mixes", f"{COUNTED}, {MIXES}")
def mix_vectors(spark, sf):
    return _mixes(spark, sf).select("query_id", "cluster", "mix")


@register("mix_cluster_means", "trace", "SELECT cluster, round(mean_s, 6) AS mean_s FROM means", f"{COUNTED}, {MIXES}")
def mix_cluster_means(spark, sf):
    return rounded(m.cluster_mean_runtime(_mixes(spark, sf)), 6, "mean_s")


@register("fit_mix_regression")
def fit_mix_regression(spark, sf):
    return m.fit_mix_regression(_mixes(spark, sf), CLUSTERS)


@register("predict_mix")
def predict_mix(spark, sf):
    mixes = staged(_mixes(spark, sf), "mixes")
    return m.predict_mix(mixes, m.fit_mix_regression(mixes, CLUSTERS))


@register(
    "mix_cost_threshold", "trace",
    """SELECT round(sum(rt * load) / sum(rt), 6) AS cost_threshold FROM (SELECT mix, sum(rt) AS rt, sum(rt / mean_s) / 25 AS load
  FROM (SELECT mix, cluster, sum(run_us) / 1000000 AS rt FROM mixes GROUP BY 1, 2) JOIN means USING (cluster) GROUP BY 1)""",
    f"{COUNTED}, {MIXES}",
)
def mix_cost_threshold(spark, sf):
    mixes = staged(_mixes(spark, sf), "mixes")
    return rounded(m.mix_cost_threshold(mixes, m.cluster_mean_runtime(mixes)), 6, "cost_threshold")


@register("mix_what_if")
def mix_what_if(spark, sf):
    mixes = staged(_mixes(spark, sf), "mixes")
    return m.mix_what_if(mixes, m.fit_mix_regression(mixes, CLUSTERS), CLUSTERS)


SEQUENCE = """feats AS (SELECT query_idx, count(*)::DOUBLE AS f1, sum(est_card) / 1e6 AS f2 FROM plan_nodes GROUP BY 1),
items AS (
  SELECT query_id, other_query_id, 1 AS side FROM pairs WHERE is_earlier UNION ALL
  SELECT query_id, other_query_id, 3 FROM pairs WHERE NOT is_earlier UNION ALL
  SELECT query_id, other_query_id, 0 FROM recent),
seq AS (
  SELECT i.query_id, i.other_query_id, i.side, b.start_us AS other_start, b.query_idx AS other_idx
  FROM items i JOIN valid b ON b.query_id = i.other_query_id
  UNION ALL SELECT query_id, NULL, 2, start_us, NULL FROM valid)"""


@register(
    "seq_features", "trace plan_nodes",
    """SELECT q.query_id, q.other_query_id, q.side, row_number() OVER (PARTITION BY q.query_id ORDER BY q.side, q.other_start, q.other_query_id) AS position,
  count(CASE WHEN q.side <= 2 THEN 1 END) OVER (PARTITION BY q.query_id) AS prior_length,
  list_transform([a.f1, a.f2, (q.side = 1)::INT::DOUBLE, (q.side = 3)::INT::DOUBLE, coalesce(b.f1, 0), coalesce(b.f2, 0),
    -abs(q.other_start - v.start_us) / 1000000, (q.side = 0)::INT::DOUBLE, 0.0], lambda x: round(x, 6)) AS vector
FROM seq q JOIN valid v ON v.query_id = q.query_id JOIN feats a ON a.query_idx = v.query_idx
LEFT JOIN feats b ON b.query_idx = q.other_idx""",
    f"{COUNTED}, {recent_of('valid', LOOKBACK_US)}, {SEQUENCE}",
)
def seq_features(spark, sf):
    # Features are rounded once per query; in an item only the relative start, third from the end, is left to round.
    features = _features(spark, sf).withColumn("features", F.transform(F.col("features").cast("array<double>"), lambda x: F.round(x, 6)))
    rows = m.sequence_features(counted(spark, sf), features, lookback_us=LOOKBACK_US)
    relative = lambda x, i: F.when(i == F.size("vector") - 3, F.round(x, 6)).otherwise(x)
    return rows.withColumn("vector", F.transform("vector", relative))


# Graphs: windows of ten minutes; the plans of the runs inside.
WINDOW_US = 600_000_000
WINDOWED = f"""spots AS (SELECT *, (start_us - (SELECT min(start_us) FROM trace)) // {WINDOW_US} AS spot FROM trace),
windowed AS (SELECT *, dense_rank() OVER (ORDER BY spot) - 1 AS window_id FROM spots
  WHERE (SELECT min(start_us) FROM trace) + (spot + 1) * {WINDOW_US} <= (SELECT max(start_us) FROM trace)),
positions AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY depth, node_pos) - 1 AS bfs_pos FROM plan_nodes),
placed AS (SELECT w.window_id, w.query_id, w.start_us, w.run_us, p.*,
    row_number() OVER (PARTITION BY w.window_id ORDER BY w.start_us, w.query_id, p.bfs_pos) - 1 AS oid
  FROM windowed w JOIN positions p USING (query_idx)),
top AS (SELECT op_name, count(*) AS n FROM plan_nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4),
oneh AS (SELECT o.op_name, list(CAST(o.op_name = t.op_name AS INT) ORDER BY t.n DESC, t.op_name)
    || [CAST(o.op_name NOT IN (SELECT op_name FROM top) AS INT)] AS op_type FROM (SELECT DISTINCT op_name FROM plan_nodes) o, top t GROUP BY 1)"""
COST = "greatest(est_cost - est_startup_cost, 1) / 1e6 AS cost"
START = "round(start_us / 1000000 + est_startup_cost / 1e6, 6)"
TIME = "CASE WHEN bfs_pos = 0 THEN run_us / 1000000 ELSE greatest(est_cost / 1e6, 1e-3) END"


def _windowed(spark, sf):
    return g.windows(view(spark, sf, "trace"), WINDOW_US)


def _placed(spark, sf):
    return g.placed_nodes(_windowed(spark, sf), view(spark, sf, "plan_nodes"))


@register("graph_windows", "trace plan_nodes", "SELECT query_id, window_id FROM windowed", WINDOWED)
def graph_windows(spark, sf):
    return _windowed(spark, sf).select("query_id", "window_id")


@register(
    "graph_nodes", "trace plan_nodes",
    f"SELECT window_id, oid, op_type, {COST}, est_card / 1e6 AS card, {START} AS start_s, {TIME} AS time_s FROM placed JOIN oneh USING (op_name)",
    WINDOWED,
)
def graph_nodes(spark, sf):
    return rounded(g.node_rows(_placed(spark, sf), operator_list(spark, sf)), 6, "start_s")


@register(
    "graph_merge_rows", "trace plan_nodes",
    f"""SELECT window_id, oid, {START} AS est_start_s, round(start_us / 1000000 + est_cost / 1e6, 6) AS est_end_s, op_type, {COST},
  {START} AS start_s, {TIME} AS time_s FROM placed JOIN oneh USING (op_name)""",
    WINDOWED,
)
def graph_merge_rows(spark, sf):
    return rounded(g.merge_rows(_placed(spark, sf), operator_list(spark, sf)), 6, "start_s", "est_start_s", "est_end_s")


@register(
    "graph_root_flags", "trace plan_nodes",
    "SELECT window_id, oid, CAST(bfs_pos = 0 AS INT) AS is_root FROM placed", WINDOWED,
)
def graph_root_flags(spark, sf):
    return g.root_flags(_placed(spark, sf))


@register(
    "graph_tree_edges", "trace plan_nodes",
    """SELECT c.window_id, c.oid AS source, c.oid - c.bfs_pos + e.parent_bfs AS target, 1.0::DOUBLE AS weight
FROM placed c JOIN edges e ON e.query_idx = c.query_idx AND e.node_pos = c.node_pos""",
    f"""{WINDOWED}, {PARENTS}, edges AS MATERIALIZED (SELECT x.query_idx, x.node_pos, p.bfs_pos AS parent_bfs
  FROM parents x JOIN positions p ON p.query_idx = x.query_idx AND p.node_pos = x.parent_pos)""",
)
def graph_tree_edges(spark, sf):
    return g.tree_edges(_windowed(spark, sf), e.with_parents(view(spark, sf, "plan_nodes")))


USES = """uses AS (SELECT n.query_idx, n.node_pos, s.column_id FROM plan_nodes n JOIN column_stats s
  ON s.tablename = n.table_name
  UNION ALL SELECT n.query_idx, n.node_pos, n.node_pos % 8 FROM plan_nodes n WHERE n.op_name = 'Hash Join'),
ntab AS (SELECT DISTINCT query_idx, node_pos, tablename AS table_name FROM uses JOIN column_stats USING (column_id))"""


def _node_tables(spark, sf):
    nodes, stats = view(spark, sf, "plan_nodes"), view(spark, sf, "column_stats")
    scans = nodes.join(stats, F.col("table_name") == F.col("tablename"))
    joins = nodes.where("op_name = 'Hash Join'").select("query_idx", "node_pos", (F.col("node_pos") % 8).alias("column_id"))
    return g.node_tables(scans.select("query_idx", "node_pos", "column_id").unionByName(joins), stats)


@register("graph_node_tables", "plan_nodes column_stats", "SELECT * FROM ntab", USES)
def graph_node_tables(spark, sf):
    return _node_tables(spark, sf)


@register(
    "graph_conflict_edges", "trace plan_nodes column_stats",
    """SELECT a.window_id, a.table_name, unnest([a.oid, b.oid]) AS source, unnest([b.oid, a.oid]) AS target,
  round(-0.1 * 2 * (a.e - b.s) / (b.e - least(a.s, b.s)), 6) AS weight
FROM used a JOIN used b ON a.window_id = b.window_id AND a.table_name = b.table_name AND a.e < b.e AND b.s < a.e""",
    f"""{WINDOWED}, {USES}, used AS (SELECT p.window_id, t.table_name, p.oid, p.start_us + p.est_startup_cost AS s, p.start_us + p.est_cost AS e
  FROM placed p JOIN ntab t USING (query_idx, node_pos))""",
)
def graph_conflict_edges(spark, sf):
    """All edges, both ways; their number grows with the square of the nodes that use a table at a time."""
    return rounded(g.conflict_edges(_placed(spark, sf), _node_tables(spark, sf), knobs=[2.0]), 6, "weight")


@register(
    "graph_training_rows", "trace plan_nodes",
    f"""SELECT window_id, oid, list_transform(op_type, lambda x: x::DOUBLE) || [cost, card, start_s] AS features, time_s AS label FROM (
  SELECT window_id, oid, op_type, {COST}, est_card / 1e6 AS card, {START} AS start_s, {TIME} AS time_s FROM placed JOIN oneh USING (op_name))""",
    WINDOWED,
)
def graph_training_rows(spark, sf):
    nodes = rounded(g.node_rows(_placed(spark, sf), operator_list(spark, sf)), 6, "start_s")
    return g.training_rows(nodes)
