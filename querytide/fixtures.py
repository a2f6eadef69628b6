"""Views over the driver's tables that stand in for traces, plans and catalogues.

Each view exists twice, once per engine: Spark builds it from the Parquet files,
the other text is the same view for the check engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# name -> (views it reads, SQL). `{...}` marks the four spots where dialects differ.
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trace": (
        (),
        """SELECT event_id AS query_id, user_id % 4 AS database_id, user_id AS client_id,
  CAST({k} AS INT) AS query_idx,
  CASE WHEN event_id % 2 = 0 THEN 'postgres' ELSE 'redshift' END AS engine,
  event_type = 'error' AS error, ts AS created_time,
  ({micros} - 1704067200000000) {div} 60 AS start_us,
  CAST(round(value*100) AS BIGINT)*10000 AS run_us
FROM events""",
    ),
    "result_log": (
        ("trace",),
        """SELECT query_id, query_idx, error, start_us, run_us AS e2e_us,
  CASE WHEN query_id % 50 = 0 THEN -1 ELSE run_us - run_us % 7 * 10000 END AS exec_us,
  run_us > 400000000 AS timeout
FROM trace""",
    ),
    "plan_nodes": (
        (),
        """SELECT query_idx, node_pos,
  CASE WHEN node_pos = 0 THEN 0 ELSE 1 + p_size % 3 END AS depth, op_name,
  CASE WHEN op_name LIKE '%Scan' THEN concat('t', CAST(p_partkey % (SELECT count(*) FROM supplier) AS {string})) END AS table_name,
  est_startup_cost, est_startup_cost + p_size * 10 AS est_cost,
  (p_partkey * 37) % 100000 + 1 AS est_card, CAST(p_size AS BIGINT) * 4 AS est_width,
  CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey * 53) % 90000 + 1 END AS act_card
FROM (SELECT *, p_partkey % 100 AS query_idx, p_partkey {div} 100 AS node_pos,
        CAST(floor(p_retailprice) AS BIGINT) AS est_startup_cost,
        CASE p_type WHEN 'ECONOMY' THEN 'Seq Scan' WHEN 'SMALL' THEN 'Index Scan'
          WHEN 'MEDIUM' THEN 'Hash Join' WHEN 'PROMO' THEN 'Hash'
          WHEN 'STANDARD' THEN 'Sort' ELSE 'Aggregate' END AS op_name FROM part) x""",
    ),
    "plan_lines": (
        ("plan_nodes",),
        """SELECT query_idx, node_pos * 2 AS line_no, concat(repeat(' ', CAST(depth * 6 AS INT)),
  CASE WHEN node_pos = 0 THEN '' ELSE '->  ' END, op_name,
  CASE WHEN table_name IS NOT NULL THEN concat(' on public.', table_name, ' ', table_name, '_a') ELSE '' END,
  '  (cost=', CAST(est_startup_cost AS {string}), '.00..', CAST(est_cost AS {string}), '.00 rows=',
  CAST(est_card AS {string}), ' width=', CAST(est_width AS {string}), ')') AS line FROM plan_nodes
UNION ALL
SELECT query_idx, node_pos * 2 + 1, concat(repeat(' ', CAST(depth * 6 + 2 AS INT)),
  'Workers Planned: ', CAST(node_pos % 5 AS {string})) FROM plan_nodes""",
    ),
    "query_text": (
        ("trace",),
        """SELECT DISTINCT query_idx, CASE WHEN query_idx % 4 = 0
  THEN concat('SELECT COUNT(*) FROM "t', CAST(query_idx % 16 AS {string}), '" LEFT OUTER JOIN "t',
    CAST(query_idx % 7 AS {string}), '" ON "t', CAST(query_idx % 16 AS {string}), '"."id" = "t',
    CAST(query_idx % 7 AS {string}), '"."fk";')
  ELSE concat('SELECT MAX(x) FROM a, b WHERE t', CAST(query_idx % 16 AS {string}), '.id = t',
    CAST(query_idx % 5 AS {string}), '.fk AND t', CAST(query_idx % 3 AS {string}), '.k=t',
    CAST(query_idx % 11 AS {string}), '.k;') END AS sql
FROM trace""",
    ),
    "table_stats": (
        (),
        """SELECT concat('t', CAST(s_suppkey AS {string})) AS relname, s_suppkey AS table_id,
  (s_suppkey * 9973) % 500000 + 1000 AS reltuples FROM supplier""",
    ),
    # Four columns per catalogue table; the share of widths that are unknown is NULL.
    "column_stats": (
        ("table_stats",),
        """SELECT relname AS tablename, table_id, c.attname, table_id * 4 + c.pos AS column_id,
  CASE WHEN (table_id + c.pos) % 7 <> 6 THEN (table_id * 13 + c.pos * 5) % 40 + 1 END AS avg_width
FROM table_stats JOIN (SELECT 0 AS pos, 'id' AS attname UNION ALL SELECT 1, 'fk'
  UNION ALL SELECT 2, 'k' UNION ALL SELECT 3, 'x') c ON true""",
    ),
    # The wide trace as a warehouse would log it: milliseconds and timestamps.
    "warehouse": (
        ("trace",),
        """SELECT query_id, database_id AS databaseId, run_us {div} 1000 AS durationTotal,
  created_time AS createdTime, {end_time} AS endTime FROM trace""",
    ),
    # One in five rows has a NULL third bind.
    "cab_templates": (
        (),
        """SELECT CAST(n_nationkey AS INT) AS template_id,
  concat('select :1, :2 from ', n_name, ' where a = :3 and b < :10 and c > :11;') AS sql
FROM nation WHERE n_nationkey BETWEEN 1 AND 22""",
    ),
    "cab_trace": (
        ("trace",),
        """SELECT query_id AS ord, query_idx % 22 + 1 AS template_id, start_us {div} 1000 AS start_ms,
  {list}CAST(query_idx AS {string}), 'b', CASE WHEN query_id % 5 <> 0 THEN 'c' END, 'd', 'e', 'f', 'g',
  'h', 'i', CAST(run_us {div} 10000000 AS {string}), 'k'{end} AS arguments FROM trace""",
    ),
    "partsupp_v": (
        (),
        """SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
  CAST(sum(l_quantity) AS BIGINT) AS ps_availqty, min(l_extendedprice) AS ps_supplycost
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    ),
}

_SPARK = {
    "k": "get_json_object(props,'$.k')",
    "micros": "unix_micros(CAST(ts AS TIMESTAMP))",
    "div": "div",
    "string": "STRING",
    "end_time": "CAST(timestamp_micros(unix_micros(CAST(created_time AS TIMESTAMP)) + run_us) AS TIMESTAMP_NTZ)",
    "list": "array(",
    "end": ")",
}
_CHECK = {
    "k": "props->>'$.k'",
    "micros": "epoch_us(ts)",
    "div": "//",
    "string": "VARCHAR",
    "end_time": "make_timestamp(epoch_us(created_time) + run_us)",
    "list": "[",
    "end": "]",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fill(sql: str, words: dict[str, str]) -> str:
    for key, word in words.items():
        sql = sql.replace("{" + key + "}", word)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A fixture view, or a driver table, as a DataFrame. ``given`` replaces tables, by a stream say."""
    if name in given:
        return given[name]
    if name not in _VIEWS:
        return table(spark, sf_dir, name)
    parents, sql = _VIEWS[name]
    base = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    frames = {p: view(spark, sf_dir, p, **given) for p in (*parents, *base)}
    sql = re.sub(rf"\bFROM ({'|'.join(frames)})\b", r"FROM {\1}", _fill(sql, _SPARK))
    return spark.sql(sql, **frames)


def check_views(*names: str) -> list[str]:
    """The views and all they read as ``name AS (...)`` items, parents first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in _VIEWS and name not in done:
            for parent in _VIEWS[name][0]:
                visit(parent)
            done.append(name)

    for name in names:
        visit(name)
    return [f"{n} AS ({_fill(_VIEWS[n][1], _CHECK)})" for n in done]


Query = Callable[[SparkSession, str], DataFrame]
