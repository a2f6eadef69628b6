"""SQL-text and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querytide.plans import explain as e
from querytide.plans import features as f
from querytide.plans import sqltext as t
from querytide.registry.base import register, view
from querytide.session import staged

CONDITIONS = r"""bare AS (
  SELECT query_idx, unnest(regexp_extract_all(sql, '(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)')) AS m FROM query_text),
quoted AS (
  SELECT query_idx, unnest(regexp_extract_all(sql, '"(\w+)"\."(\w+)"\s*=\s*"(\w+)"\."(\w+)"')) AS m FROM query_text
  WHERE query_idx NOT IN (SELECT query_idx FROM bare)),
conds AS (
  SELECT query_idx, regexp_extract(m, '^(\w+)\.', 1) AS t1, regexp_extract(m, '^\w+\.(\w+)', 1) AS c1,
    regexp_extract(m, '=\s*(\w+)\.', 1) AS t2, regexp_extract(m, '\.(\w+)$', 1) AS c2
  FROM (SELECT query_idx, replace(m, '"', '') AS m FROM (SELECT * FROM bare UNION ALL SELECT * FROM quoted)))"""
TOUCHED = CONDITIONS + """,
touched AS (SELECT DISTINCT query_idx, unnest([t1, t2]) AS name FROM conds)"""
TABLES = [f"t{i}" for i in range(16)]


def texts(spark, sf):
    return view(spark, sf, "query_text")


@register("sql_join_conditions", "query_text", "SELECT query_idx, t1, c1, t2, c2 FROM conds", CONDITIONS)
def sql_join_conditions(spark, sf):
    found = texts(spark, sf).select("query_idx", F.explode(t.join_conditions(F.col("sql"))).alias("c"))
    return found.select("query_idx", "c.*")


@register(
    "sql_join_conditions_canonical", "query_text",
    """SELECT DISTINCT query_idx, CASE WHEN a < b THEN a ELSE b END AS t1, CASE WHEN a < b THEN c1 ELSE c2 END AS c1,
  CASE WHEN a < b THEN b ELSE a END AS t2, CASE WHEN a < b THEN c2 ELSE c1 END AS c2
FROM (SELECT *, t1 || '_brad_source' AS a, t2 || '_brad_source' AS b FROM conds)""",
    CONDITIONS,
)
def sql_join_conditions_canonical(spark, sf):
    canonical = t.canonical_conditions(t.join_conditions(F.col("sql")), source_suffix=True)
    return texts(spark, sf).select("query_idx", F.explode(canonical).alias("c")).select("query_idx", "c.*")


@register(
    "sql_format_join_condition", "query_text",
    "SELECT query_idx, t1 || '.' || c1 || ' = ' || t2 || '.' || c2 AS condition FROM conds", CONDITIONS,
)
def sql_format_join_condition(spark, sf):
    found = texts(spark, sf).select("query_idx", F.explode(t.join_conditions(F.col("sql"))).alias("c"))
    return found.select("query_idx", t.condition_text(F.col("c")).alias("condition"))


@register("sql_touched_tables", "query_text", "SELECT query_idx, name FROM touched", TOUCHED)
def sql_touched_tables(spark, sf):
    return texts(spark, sf).select("query_idx", F.explode(t.touched_tables(F.col("sql"))).alias("name"))


HOT = """hot AS (
  SELECT q.query_idx, list(CAST(EXISTS (SELECT 1 FROM touched x WHERE x.query_idx = q.query_idx AND x.name = 't' || i) AS INT)
    ORDER BY i) AS tables FROM query_text q, range(16) r(i) GROUP BY 1)"""


@register("sql_table_multihot", "query_text", "SELECT query_idx, tables FROM hot", f"{TOUCHED}, {HOT}")
def sql_table_multihot(spark, sf):
    return texts(spark, sf).select("query_idx", t.table_multihot(F.col("sql"), TABLES).alias("tables"))


@register(
    "sql_runtime_table_features", "query_text",
    """SELECT query_idx, tables, round(median_us, 3) AS median_us, round(std_us, 3) AS std_us FROM hot JOIN (
  SELECT query_idx, quantile_cont(run_us, 0.5) AS median_us, stddev_pop(run_us) AS std_us FROM trace GROUP BY 1) USING (query_idx)""",
    f"{TOUCHED}, {HOT}",
)
def sql_runtime_table_features(spark, sf):
    found = t.runtime_table_features(view(spark, sf, "trace"), texts(spark, sf), TABLES)
    return found.withColumns({c: F.round(c, 3) for c in ("median_us", "std_us")})


@register(
    "trace_num_tables", "query_text",
    """SELECT query_id, query_idx, CAST(n AS INT) AS num_tables FROM trace LEFT JOIN (
  SELECT query_idx, count(*) AS n FROM touched GROUP BY 1) USING (query_idx)""",
    TOUCHED,
)
def trace_num_tables(spark, sf):
    counted = t.with_table_count(view(spark, sf, "trace"), texts(spark, sf))
    return counted.select("query_id", "query_idx", "num_tables")


PARSED = r"""opened AS (
  SELECT *, sum(CASE WHEN line_no = 0 OR ltrim(line) LIKE '->%' THEN 1 ELSE 0 END) OVER (
    PARTITION BY query_idx ORDER BY line_no) - 1 AS node_pos FROM plan_lines),
parsed AS (
  SELECT query_idx, CAST(node_pos AS BIGINT) AS node_pos,
    CASE WHEN line_no = 0 THEN 0 ELSE length(line) - length(ltrim(line)) END AS depth,
    trim(split_part(regexp_extract(line, '^ *(?:->  )?([^"(]+)', 1), ' on ', 1)) AS op_name,
    nullif(regexp_extract(line, ' on public\.(\w+) ', 1), '') AS table_name,
    nullif(regexp_extract(line, ' on public\.\w+ (\w+) ', 1), '') AS alias,
    CAST(regexp_extract(line, 'cost=(\d+\.\d+)\.\.', 1) AS DOUBLE) AS est_startup_cost,
    CAST(regexp_extract(line, '\.\.(\d+\.\d+) rows', 1) AS DOUBLE) AS est_cost,
    CAST(regexp_extract(line, 'rows=(\d+)', 1) AS DOUBLE) AS est_card,
    CAST(regexp_extract(line, 'width=(\d+)', 1) AS DOUBLE) AS est_width
  FROM opened WHERE line LIKE '%(cost=%'),
workers AS (SELECT query_idx, node_pos, CAST(regexp_extract(line, 'Workers Planned: (\d+)', 1) AS INT) AS workers_planned
  FROM opened WHERE line LIKE '%Workers Planned%')"""


@register(
    "plan_parse_lines", "plan_lines",
    """SELECT p.*, CAST(NULL AS DOUBLE) AS act_startup_cost, CAST(NULL AS DOUBLE) AS act_time,
  CAST(NULL AS DOUBLE) AS act_card, w.workers_planned FROM parsed p LEFT JOIN workers w USING (query_idx, node_pos)""",
    PARSED,
)
def plan_parse_lines(spark, sf):
    return e.plan_nodes(view(spark, sf, "plan_lines"))


PARENTS = """parents AS (
  SELECT n.query_idx, n.node_pos, (SELECT max(m.node_pos) FROM plan_nodes m WHERE m.query_idx = n.query_idx
    AND m.node_pos < n.node_pos AND m.depth < n.depth) AS parent_pos FROM plan_nodes n)"""


def nodes(spark, sf):
    return view(spark, sf, "plan_nodes")


@register("plan_parents", "plan_nodes", "SELECT * FROM parents", PARENTS)
def plan_parents(spark, sf):
    return e.with_parents(nodes(spark, sf)).select("query_idx", "node_pos", "parent_pos")


# Two timed runs per query, as the last lines of an ANALYZE output.
TIMED = """timed AS (
  SELECT query_idx, 100000 + query_id * 2 AS line_no, 'Planning Time: ' || query_idx || '.25 ms' AS line FROM trace
  UNION ALL
  SELECT query_idx, 100001 + query_id * 2, 'Execution Time: ' || run_us // 1000000 || '.5 ms' FROM trace)"""


def timed(spark, sf):
    return view(spark, sf, "trace").select(
        "query_idx",
        F.explode(
            F.array(
                F.struct(
                    (100000 + F.col("query_id") * 2).alias("line_no"),
                    F.concat(F.lit("Planning Time: "), F.col("query_idx").cast("string"), F.lit(".25 ms")).alias("line"),
                ),
                F.struct(
                    (100001 + F.col("query_id") * 2).alias("line_no"),
                    F.concat(F.lit("Execution Time: "), F.expr("run_us div 1000000").cast("string"), F.lit(".5 ms")).alias("line"),
                ),
            )
        ).alias("l"),
    ).select("query_idx", "l.*")


@register(
    "plan_times", "trace",
    """SELECT query_idx, round(avg(TRY_CAST(regexp_extract(line, 'Planning Time: (.*) ms', 1) AS DOUBLE)), 6) AS planning_ms,
  round(avg(TRY_CAST(regexp_extract(line, 'Execution Time: (.*) ms', 1) AS DOUBLE)), 6) AS execution_ms
FROM timed GROUP BY 1""",
    TIMED,
)
def plan_times(spark, sf):
    return e.plan_times(timed(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("planning_ms", "execution_ms")}
    )


# Every ninth query gets an init plan line.
NESTED = """lines AS (
  SELECT * FROM plan_lines UNION ALL
  SELECT DISTINCT query_idx, CAST(1000000000 AS BIGINT), 'InitPlan 1 (returns $0)' FROM plan_lines WHERE query_idx % 9 = 0)"""


def nested_lines(spark, sf):
    lines = view(spark, sf, "plan_lines")
    extra = lines.where("query_idx % 9 = 0").select(
        "query_idx", F.lit(1_000_000_000).cast("bigint").alias("line_no"), F.lit("InitPlan 1 (returns $0)").alias("line")
    ).distinct()
    return lines.unionByName(extra)


@register(
    "plan_skip_subplans", "plan_lines",
    "SELECT query_idx, line_no FROM lines WHERE query_idx NOT IN (SELECT query_idx FROM lines WHERE line LIKE '%InitPlan%')",
    NESTED,
)
def plan_skip_subplans(spark, sf):
    return e.usable_plans(nested_lines(spark, sf)).select("query_idx", "line_no")


@register(
    "plan_merge", "plan_nodes",
    """SELECT query_idx, node_pos, op_name, CASE WHEN node_pos % 2 = 0 THEN est_card + 1 ELSE est_card END AS est_card,
  act_card, true AS matches FROM plan_nodes""",
)
def plan_merge(spark, sf):
    analyzed = nodes(spark, sf).select("query_idx", "node_pos", "op_name", "est_card", "act_card")
    changed = F.when(F.col("node_pos") % 2 == 0, F.col("est_card") + 1)
    verbose = analyzed.select("query_idx", "node_pos", "op_name", changed.alias("est_card"))
    return e.merge_plans(analyzed, verbose)


@register(
    "plan_children_product", "plan_nodes",
    """SELECT n.query_idx, n.node_pos, round(ln(coalesce(a, 1)), 6) AS act_children_card,
  round(ln(coalesce(b, 1)), 6) AS est_children_card FROM plan_nodes n LEFT JOIN (
  SELECT query_idx, parent_pos AS node_pos, product(act_card) AS a, product(est_card) AS b
  FROM plan_nodes JOIN parents USING (query_idx, node_pos) GROUP BY 1, 2) c USING (query_idx, node_pos)""",
    PARENTS,
)
def plan_children_product(spark, sf):
    products = f.children_product(e.with_parents(nodes(spark, sf)))
    return products.withColumns({c: F.round(F.log(c), 6) for c in ("act_children_card", "est_children_card")})


@register(
    "plan_tables", "plan_nodes",
    """SELECT query_idx, coalesce(list_sort(list(DISTINCT table_name) FILTER (table_name IS NOT NULL)), []) AS tables,
  list_sort(list(DISTINCT op_name)) AS operators, CAST(count(DISTINCT table_name) AS INT) AS num_tables
FROM plan_nodes GROUP BY 1""",
)
def plan_tables(spark, sf):
    return f.plan_tables(nodes(spark, sf))


@register(
    "plan_min_card", "plan_nodes",
    "SELECT query_idx, coalesce(CAST(min(act_card) AS DOUBLE), 'infinity'::DOUBLE) AS min_card FROM plan_nodes GROUP BY 1",
)
def plan_min_card(spark, sf):
    return f.min_card(nodes(spark, sf))


@register(
    "plan_table_ids", "plan_nodes table_stats",
    """SELECT query_idx, node_pos, table_id FROM plan_nodes LEFT JOIN (
  SELECT relname AS table_name, table_id FROM table_stats) USING (table_name)""",
)
def plan_table_ids(spark, sf):
    return f.with_table_ids(nodes(spark, sf), view(spark, sf, "table_stats")).select("query_idx", "node_pos", "table_id")


# Scans refer to a column by alias or, every third, by a bare name; other nodes by a bare name.
REFS = """refs AS (
  SELECT query_idx, node_pos AS ref_id, table_name,
    CASE WHEN table_name IS NOT NULL AND node_pos % 3 <> 0 THEN table_name || '_a' END AS alias,
    CASE WHEN node_pos % 11 = 0 THEN 'zz' ELSE ['id', 'fk', 'k', 'x'][node_pos % 4 + 1] END AS col FROM plan_nodes)"""


def aliased_nodes(spark, sf):
    return nodes(spark, sf).withColumn("alias", F.concat("table_name", F.lit("_a")))


def refs(spark, sf):
    bare = F.col("table_name").isNull() | (F.col("node_pos") % 3 == 0)
    name = F.when(F.col("node_pos") % 11 == 0, "zz").otherwise(
        F.get(F.array(*map(F.lit, ("id", "fk", "k", "x"))), (F.col("node_pos") % 4).cast("int"))
    )
    return aliased_nodes(spark, sf).select(
        "query_idx", F.col("node_pos").alias("ref_id"),
        F.when(~bare, F.col("alias")).alias("alias"), name.alias("column"),
    )


@register(
    "plan_column_lookup", "plan_nodes column_stats",
    """SELECT query_idx, ref_id, column_id, CASE WHEN alias IS NULL AND n > 1 THEN 'ambiguous'
  WHEN column_id IS NULL THEN 'unknown' END AS error FROM (
  SELECT r.query_idx, r.ref_id, r.alias, count(s.column_id) AS n,
    CASE WHEN r.alias IS NOT NULL OR count(s.column_id) = 1 THEN min(s.column_id) END AS column_id
  FROM refs r LEFT JOIN (SELECT DISTINCT query_idx, table_name FROM plan_nodes WHERE table_name IS NOT NULL) p
    ON p.query_idx = r.query_idx AND (r.alias IS NULL OR p.table_name = r.table_name)
  LEFT JOIN column_stats s ON s.tablename = p.table_name AND s.attname = r.col
  GROUP BY 1, 2, 3)""",
    REFS,
)
def plan_column_lookup(spark, sf):
    return f.column_lookup(refs(spark, sf), aliased_nodes(spark, sf), view(spark, sf, "column_stats"))


@register(
    "plan_corpus_summary", "plan_nodes plan_lines",
    """SELECT count(*) AS parsed, round(avg(num_tables), 6) AS mean_tables, CAST(max(num_tables) AS INT) AS max_tables,
  round(avg(runtime_ms / 1000), 6) AS mean_runtime_s, round(max(runtime_ms / 1000), 6) AS max_runtime_s,
  round(quantile_cont(num_tables, 0.5), 6) AS median_tables, round(quantile_cont(runtime_ms, 0.5) / 1000, 6) AS median_runtime_s,
  (SELECT count(DISTINCT query_idx) FROM lines WHERE query_idx % 9 = 0) AS skipped
FROM (SELECT query_idx, count(DISTINCT table_name) AS num_tables FROM plan_nodes GROUP BY 1) JOIN (
  SELECT query_idx, avg(run_us / 1000) AS runtime_ms FROM trace GROUP BY 1) USING (query_idx)
WHERE query_idx % 9 <> 0""",
    f"trace AS (SELECT CAST(props->>'$.k' AS INT) AS query_idx, CAST(round(value*100) AS BIGINT)*10000 AS run_us FROM events), {NESTED}",
)
def plan_corpus_summary(spark, sf):
    lines = nested_lines(spark, sf)
    usable = e.usable_plans(lines).select("query_idx").distinct()
    runtimes = view(spark, sf, "trace").groupBy("query_idx").agg(F.avg(F.col("run_us") / 1000).alias("runtime_ms"))
    plans = f.plan_tables(nodes(spark, sf)).join(usable, "query_idx", "left_semi").join(runtimes, "query_idx")
    skipped = lines.join(usable, "query_idx", "left_anti").agg(F.countDistinct("query_idx")).scalar()
    plans = staged(plans, "corpus")
    summary = f.corpus_summary(plans.select("query_idx", "num_tables", "runtime_ms"), skipped)
    halves = ("mean_tables", "mean_runtime_s", "max_runtime_s", "median_tables", "median_runtime_s")
    return summary.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in halves})


@register(
    "plan_filter_shares", "plan_nodes",
    """SELECT operator, count(*) AS n, round(count(*) / (SELECT count(DISTINCT query_idx) FROM plan_nodes), 6) AS share
FROM (SELECT DISTINCT query_idx, est_width AS col, ['=', '<', 'LIKE'][node_pos % 3 + 1] AS operator FROM plan_nodes) GROUP BY 1""",
)
def plan_filter_shares(spark, sf):
    kinds = F.array(*map(F.lit, ("=", "<", "LIKE")))
    filters = nodes(spark, sf).select(
        "query_idx", F.col("est_width").alias("column"), F.get(kinds, (F.col("node_pos") % 3).cast("int")).alias("operator")
    )
    shares = f.filter_operator_share(filters, nodes(spark, sf).select("query_idx").distinct())
    return shares.withColumn("share", F.round("share", 6))


@register("plan_cardinalities", "plan_nodes", "SELECT query_idx, node_pos, coalesce(act_card, est_card) * est_width AS card FROM plan_nodes")
def plan_cardinalities(spark, sf):
    return f.cardinalities(nodes(spark, sf), with_width=True, true_card=True)


TOP = """top AS (SELECT op_name, count(*) AS n FROM plan_nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)"""
OPERATORS_K = 4


@register(
    "plan_top_operators", "plan_nodes",
    """SELECT op_name, n, CAST(row_number() OVER (ORDER BY n DESC, op_name) AS INT) AS place,
  round((SELECT sum(n) FROM top) / (SELECT count(*) FROM plan_nodes), 9) AS covered FROM top""",
    TOP,
)
def plan_top_operators(spark, sf):
    return f.top_operators(nodes(spark, sf), OPERATORS_K).withColumn("covered", F.round("covered", 9))


@register(
    "plan_top_tables", "table_stats",
    "SELECT relname, table_id, reltuples FROM table_stats ORDER BY reltuples DESC, relname LIMIT 5",
)
def plan_top_tables(spark, sf):
    return f.top_tables(view(spark, sf, "table_stats"), 5)


def operator_list(spark, sf, k=OPERATORS_K):
    """The k most frequent operators: k names on the driver, as a pivot needs them."""
    return [r["op_name"] for r in f.top_operators(nodes(spark, sf), k).orderBy("place").collect()]


@register(
    "plan_features", "plan_nodes table_stats",
    """SELECT n.query_idx, list_transform(
  list_concat(
    (SELECT flatten(list([c, s] ORDER BY t.n DESC, t.op_name)) FROM top t LEFT JOIN (
      SELECT query_idx, op_name, count(*)::DOUBLE AS c, sum(est_card * est_width)::DOUBLE AS s FROM plan_nodes GROUP BY 1, 2) g
      ON g.op_name = t.op_name AND g.query_idx = n.query_idx),
    (SELECT list(s ORDER BY b.reltuples DESC, b.relname) FROM big b LEFT JOIN (
      SELECT query_idx, table_name, sum(est_card * est_width)::DOUBLE AS s FROM plan_nodes WHERE op_name IN (SELECT op_name FROM top)
      GROUP BY 1, 2) g ON g.table_name = b.relname AND g.query_idx = n.query_idx)),
  lambda x: round(greatest(ln(coalesce(x, 0) + 1e-5), 0), 6)) AS features
FROM (SELECT DISTINCT query_idx FROM plan_nodes WHERE op_name IN (SELECT op_name FROM top)) n""",
    f"{TOP}, big AS (SELECT relname, reltuples FROM table_stats ORDER BY reltuples DESC, relname LIMIT 5)",
)
def plan_features(spark, sf):
    sizes = [(r["relname"], float(r["reltuples"])) for r in f.top_tables(view(spark, sf, "table_stats"), 5).collect()]
    built = f.plan_features(nodes(spark, sf), operator_list(spark, sf), sizes, with_width=True)
    return built.select("query_idx", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@register(
    "plan_memory_estimate", "plan_nodes",
    """SELECT query_idx, round(max(est_card * est_width) / 1048576, 6) AS memory_mb FROM plan_nodes
WHERE op_name IN (SELECT op_name FROM top) GROUP BY 1""",
    TOP,
)
def plan_memory_estimate(spark, sf):
    built = f.memory_estimate(nodes(spark, sf), operator_list(spark, sf))
    return built.withColumn("memory_mb", F.round("memory_mb", 6))


@register(
    "plan_scan_mb", "plan_nodes column_stats",
    """SELECT query_idx, table_name, round(sum(est_card * w) / 1048576, 6) AS scan_mb FROM plan_nodes JOIN (
  SELECT tablename AS table_name, sum(avg_width) AS w FROM column_stats GROUP BY 1) USING (table_name) GROUP BY 1, 2""",
)
def plan_scan_mb(spark, sf):
    return f.scan_mb(nodes(spark, sf), view(spark, sf, "column_stats")).withColumn("scan_mb", F.round("scan_mb", 6))


@register(
    "plan_scan_mb_column_store", "plan_nodes column_stats",
    """SELECT n.query_idx, n.table_name, round(sum(coalesce(act_card, est_card) * coalesce(avg_width, 0)) / 1048576, 6) AS scan_mb
FROM plan_nodes n LEFT JOIN column_stats s ON s.tablename = n.table_name AND s.column_id % 4 = n.node_pos % 4
WHERE n.table_name IS NOT NULL GROUP BY 1, 2""",
)
def plan_scan_mb_column_store(spark, sf):
    stats = view(spark, sf, "column_stats")
    out = nodes(spark, sf).join(stats, F.col("table_name") == F.col("tablename")).where("column_id % 4 = node_pos % 4")
    found = f.scan_mb(nodes(spark, sf), stats, True, out.select("query_idx", "node_pos", "column_id"))
    return found.withColumn("scan_mb", F.round("scan_mb", 6))


@register(
    "plan_table_sizes", "column_stats table_stats",
    """SELECT relname, table_id, round(reltuples * w / 1048576, 6) AS size_mb FROM table_stats JOIN (
  SELECT tablename AS relname, sum(CASE WHEN avg_width > 0 THEN avg_width ELSE 0 END) AS w FROM column_stats GROUP BY 1) USING (relname)""",
)
def plan_table_sizes(spark, sf):
    sizes = f.table_sizes(view(spark, sf, "column_stats"), view(spark, sf, "table_stats"))
    return sizes.withColumn("size_mb", F.round("size_mb", 6))


def _profile_check(columns):
    one = """SELECT '{c}' AS attname, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS null_frac,
  round({w}, 6) AS avg_width, count(DISTINCT {c}) AS n_distinct,
  (SELECT round(corr(r, p_partkey), 6) FROM (SELECT row_number() OVER (ORDER BY {c}, p_partkey) AS r, p_partkey FROM part)) AS correlation
FROM part"""
    return "\nUNION ALL\n".join(one.replace("{c}", c).replace("{w}", w) for c, w in columns.items())


@register(
    "profile_columns", "",
    _profile_check({
        "p_partkey": "8.0::DOUBLE", "p_name": "avg(strlen(p_name))", "p_brand": "avg(strlen(p_brand))",
        "p_type": "avg(strlen(p_type))", "p_size": "4.0::DOUBLE", "p_retailprice": "8.0::DOUBLE",
    }),
)
def profile_columns(spark, sf):
    profile = f.profile_columns(view(spark, sf, "part"), "p_partkey").drop("data_type")
    return profile.withColumns({c: F.round(c, 6) for c in ("null_frac", "avg_width", "correlation")})


PROFILED = {
    "nation": ("n_nationkey", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}),
    "supplier": ("s_suppkey", {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}),
    "orders": ("o_orderkey", {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}),
}


def _profiles_check() -> str:
    """Types are those of the files."""
    sizes = {"INTEGER": "4", "BIGINT": "8", "DOUBLE": "8", "TIMESTAMP": "8"}
    width = " ".join(f"WHEN '{k}' THEN {w}" for k, w in sizes.items())
    names = "CASE typeof({c}) WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END"
    parts = [
        f"""SELECT '{t}' AS tablename, '{c}' AS attname, any_value({names.format(c=c)}) AS data_type, round(avg(({c} IS NULL)::INT), 6) AS null_frac,
  round(CASE any_value(typeof({c})) {width} ELSE avg(strlen(CAST({c} AS VARCHAR))) END::DOUBLE, 6) AS avg_width, count(DISTINCT {c}) AS n_distinct,
  round(corr(r, {order}) + 1e-9, 6) AS correlation FROM (SELECT *, row_number() OVER (ORDER BY {c}, {order}) AS r FROM {t})"""
        for t, (order, columns) in PROFILED.items() for c in columns
    ]
    return " UNION ALL ".join(parts)


@register("profile_tables", "", _profiles_check())
def profile_tables(spark, sf):
    tables = {t: (view(spark, sf, t).select(*columns), order) for t, (order, columns) in PROFILED.items()}
    rows = f.profile_tables(tables)
    return rows.withColumns({c: F.round(c, 6) for c in ("null_frac", "avg_width")} | {"correlation": F.round(F.col("correlation") + 1e-9, 6)})
