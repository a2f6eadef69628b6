"""The shipped SQL workload on the driver's tables."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from querytide.registry.base import CHECK, SPARK, check_sql, register, view
from querytide.workload import templates
from querytide.workload.star import corpus_query, star, star_aggregate

VOLUME = "l_extendedprice * (1 - l_discount)"

# name -> (columns rounded to that many digits, check SQL).
CHECKS = {
    "q01": (
        {"sum_disc_price": 4, "sum_charge": 2, "sum_qty": 2, "sum_base_price": 2, "avg_qty": 6, "avg_price": 4, "avg_disc": 6},
        f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({VOLUME}), 4) AS sum_disc_price, round(sum({VOLUME} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
  round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    ),
    "q02": (
        {},
        """SELECT s_acctbal, s_name, n_name, p_partkey, p_name FROM (
  SELECT *, rank() OVER (PARTITION BY ps_partkey ORDER BY ps_supplycost) AS place
  FROM partsupp_v JOIN part ON ps_partkey = p_partkey JOIN supplier ON ps_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE p_size <= 10 AND p_type LIKE '%LL' AND r_name = 'EUROPE') WHERE place = 1""",
    ),
    "q03": (
        {"revenue": 4},
        f"""SELECT l_orderkey, o_orderdate, round(sum({VOLUME}), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY 1, 2""",
    ),
    "q04": (
        {},
        """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
AND o_orderdate < TIMESTAMP '1998-04-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY)
GROUP BY 1""",
    ),
    "q05": (
        {"revenue": 4},
        f"""SELECT n_name, round(sum({VOLUME}), 4) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""",
    ),
    "q06": (
        {"revenue": 4},
        """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'
AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    ),
    "q07": (
        {"revenue": 4},
        f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum({VOLUME}), 4) AS revenue
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
WHERE (a.n_name, b.n_name) IN (('NATION_1', 'NATION_2'), ('NATION_2', 'NATION_1'))
AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1, 2, 3""",
    ),
    "q08": (
        {"mkt_share": 6},
        f"""SELECT CAST(year(o_orderdate) AS INT) AS o_year, round(sum(CASE WHEN s.n_name = 'NATION_3' THEN {VOLUME} ELSE 0 END) / sum({VOLUME}), 6) AS mkt_share
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation c ON c.n_nationkey = c_nationkey JOIN region ON r_regionkey = c.n_regionkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation s ON s.n_nationkey = s_nationkey WHERE r_name = 'EUROPE' AND p_type = 'ECONOMY'
AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1""",
    ),
    "q09": (
        {"sum_profit": 4},
        f"""SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, round(sum({VOLUME} - ps_supplycost * l_quantity), 4) AS sum_profit
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN partsupp_v ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE p_name LIKE '%small%' GROUP BY 1, 2""",
    ),
    "q10": (
        {"revenue": 4},
        f"""SELECT c_custkey, c_name, round(sum({VOLUME}), 4) AS revenue, c_acctbal, n_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_returnflag = 'R'
AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2, 4, 5""",
    ),
    "q11": (
        {"value": 2},
        """SELECT ps_partkey, round(v, 2) AS value FROM (SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS v,
  sum(sum(ps_supplycost * ps_availqty)) OVER () AS total FROM partsupp_v JOIN supplier ON ps_suppkey = s_suppkey
  JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_4' GROUP BY 1) WHERE v > total * 0.001""",
    ),
    "q12": (
        {},
        """SELECT l_returnflag, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count,
  count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1""",
    ),
    "q13": (
        {},
        """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders
  ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '%SPEC%' GROUP BY 1) GROUP BY 1""",
    ),
    "q14": (
        {"promo_revenue": 6},
        f"""SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {VOLUME} ELSE 0 END) / sum({VOLUME}), 6) AS promo_revenue
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""",
    ),
    "q15": (
        {},
        f"""SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN (
  SELECT l_suppkey, round(sum({VOLUME}), 4) AS total_revenue, max(round(sum({VOLUME}), 4)) OVER () AS top FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1) ON l_suppkey = s_suppkey WHERE total_revenue = top""",
    ),
    "q16": (
        {},
        """SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp_v JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""",
    ),
    "q17": (
        {"avg_yearly": 4},
        """SELECT round(sum(l_extendedprice) / 7, 4) AS avg_yearly FROM (
  SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE p_brand = 'Brand#3' AND p_size < 25) WHERE l_quantity < 0.2 * mean""",
    ),
    "q18": (
        {},
        """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING sum(l_quantity) > 250""",
    ),
    "q19": (
        {"revenue": 4},
        f"""SELECT round(sum({VOLUME}), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('A', 'N') AND (
  p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15 OR
  p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30 OR
  p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    ),
    "q20": (
        {},
        """SELECT s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN ('NATION_1', 'NATION_2') AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp_v WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%') AND ps_availqty > (
    SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
    AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'))""",
    ),
    "q21": (
        {},
        """SELECT s_name, count(*) AS numwait FROM late a JOIN supplier ON s_suppkey = a.l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE n_name = 'NATION_5'
AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM late c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey) GROUP BY 1""",
    ),
    "q22": (
        {"totacctbal": 2},
        """SELECT c_nationkey AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (1, 3, 7, 9, 13, 17, 23) AND c_acctbal > (
  SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 7, 9, 13, 17, 23))
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01') GROUP BY 1""",
    ),
}
LATE = """late AS (SELECT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus = 'F' AND l_shipdate > o_orderdate + INTERVAL 60 DAY)"""


def _template(name: str, digits: dict[str, int]):
    job = getattr(templates, name)
    tables = [p.name for p in inspect.signature(job).parameters.values() if p.default is inspect.Parameter.empty]

    def query(spark, sf):
        given = {t: view(spark, sf, "partsupp_v" if t == "partsupp" else t) for t in tables}
        return job(**given).withColumns({c: F.round(c, d) for c, d in digits.items()}) if digits else job(**given)

    query.__module__ = __name__
    return query


for _name, (_digits, _sql) in CHECKS.items():
    SPARK[_name] = _template(_name, _digits)
    CHECK[_name] = check_sql("partsupp_v" if "partsupp_v" in _sql else "", LATE if _name == "q21" else "", _sql)


def _star(spark, sf):
    """lineitem -> orders -> customer -> nation -> region, all left outer."""
    t = {n: view(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    return star(
        t["lineitem"],
        [
            (t["orders"], "l_orderkey", "o_orderkey"),
            (t["customer"], "o_custkey", "c_custkey"),
            (t["nation"], "c_nationkey", "n_nationkey"),
            (t["region"], "n_regionkey", "r_regionkey"),
        ],
    )


def _customers(spark, sf):
    """customer -> orders -> lineitem and nation, all left outer: many customers have no orders."""
    t = {n: view(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation")}
    return star(
        t["customer"],
        [(t["orders"], "c_custkey", "o_custkey"), (t["lineitem"], "o_orderkey", "l_orderkey"), (t["nation"], "c_nationkey", "n_nationkey")],
    )


STAR = """star AS (SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""
CUSTOMERS = """star AS (SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey
  LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


@register(
    "star_scalar_agg", "",
    """SELECT count(*) AS agg_0, sum(o_custkey)::BIGINT AS agg_1, round(avg(c_acctbal), 4) AS agg_2, min(n_nationkey) AS agg_3, max(l_partkey) AS agg_4
FROM star WHERE r_name <> 'ASIA' AND o_totalprice >= 1000.5 AND l_quantity <= 40""",
    STAR,
)
def star_scalar_agg(spark, sf):
    return star_aggregate(
        _star(spark, sf),
        {
            "agg_0": F.count(F.lit(1)), "agg_1": F.sum("o_custkey"), "agg_2": F.round(F.avg("c_acctbal"), 4),
            "agg_3": F.min("n_nationkey"), "agg_4": F.max("l_partkey"),
        },
        (F.col("r_name") != "ASIA") & (F.col("o_totalprice") >= 1000.5) & (F.col("l_quantity") <= 40),
    )


@register(
    "star_group_agg", "",
    """SELECT n_name, o_orderpriority, count(*) AS agg_0, round(sum(l_extendedprice), 2) AS agg_1 FROM star
WHERE l_quantity >= 5.25 GROUP BY 1, 2""",
    STAR,
)
def star_group_agg(spark, sf):
    aggs = {"agg_0": F.count(F.lit(1)), "agg_1": F.round(F.sum("l_extendedprice"), 2)}
    return star_aggregate(_star(spark, sf), aggs, F.col("l_quantity") >= 5.25, ["n_name", "o_orderpriority"])


@register(
    "star_outer_null", "",
    """SELECT o_orderkey IS NULL AS without_orders, count(*) AS agg_0, max(c_custkey) AS agg_1, count(l_orderkey) AS agg_2 FROM star
WHERE l_orderkey IS NULL OR (n_name IS NOT NULL AND l_returnflag = 'R') GROUP BY 1""",
    CUSTOMERS,
)
def star_outer_null(spark, sf):
    where = F.col("l_orderkey").isNull() | (F.col("n_name").isNotNull() & (F.col("l_returnflag") == "R"))
    aggs = {"agg_0": F.count(F.lit(1)), "agg_1": F.max("c_custkey"), "agg_2": F.count("l_orderkey")}
    rows = _customers(spark, sf).withColumn("without_orders", F.col("o_orderkey").isNull())
    return star_aggregate(rows, aggs, where, ["without_orders"])


@register(
    "star_pattern", "",
    """SELECT min(c_custkey) AS agg_0, count(*) AS agg_1 FROM star WHERE c_name LIKE '%Cust%1%' AND (n_name NOT LIKE '%NAT%2%'
OR o_orderpriority LIKE '%U%GENT' OR r_name LIKE 'A%' AND o_orderpriority NOT LIKE '%LOW%')""",
    STAR,
)
def star_pattern(spark, sf):
    priority = F.col("o_orderpriority")
    where = F.col("c_name").like("%Cust%1%") & (
        ~F.col("n_name").like("%NAT%2%")
        | priority.like("%U%GENT")
        | (F.col("r_name").like("A%") & ~priority.like("%LOW%"))
    )
    return star_aggregate(_star(spark, sf), {"agg_0": F.min("c_custkey"), "agg_1": F.count(F.lit(1))}, where)


@register(
    "star_range_in", "",
    """SELECT round(avg(o_totalprice), 4) AS agg_0, count(*) AS agg_1 FROM star WHERE c_custkey BETWEEN 54 AND 61045
AND r_name IN ('ASIA', 'EUROPE') AND n_nationkey <> 4 AND l_linenumber >= 2.4567""",
    STAR,
)
def star_range_in(spark, sf):
    where = (
        F.col("c_custkey").between(54, 61045)
        & F.col("r_name").isin("ASIA", "EUROPE")
        & (F.col("n_nationkey") != 4)
        & (F.col("l_linenumber") >= 2.4567)
    )
    return star_aggregate(_star(spark, sf), {"agg_0": F.round(F.avg("o_totalprice"), 4), "agg_1": F.count(F.lit(1))}, where)


@register(
    "star_big_scan", "",
    "SELECT round(avg(l_partkey), 4) AS agg_0, round(avg(l_suppkey), 4) AS agg_1 FROM lineitem WHERE l_orderkey < 12000",
)
def star_big_scan(spark, sf):
    aggs = {"agg_0": F.round(F.avg("l_partkey"), 4), "agg_1": F.round(F.avg("l_suppkey"), 4)}
    return star_aggregate(view(spark, sf, "lineitem"), aggs, F.col("l_orderkey") < 12000)


CORPUS = """SELECT MAX("lineitem"."l_partkey") AS agg_0, COUNT(*) AS agg_1 FROM "lineitem"
LEFT OUTER JOIN "orders" ON "lineitem"."l_orderkey" = "orders"."o_orderkey"
LEFT OUTER JOIN "customer" ON "orders"."o_custkey" = "customer"."c_custkey"
WHERE "customer"."c_mktsegment" IN ('BUILDING', 'MACHINERY') AND "lineitem"."l_quantity" >= 15.84"""


@register("star_corpus_text", "", CORPUS)
def star_corpus_text(spark, sf):
    return corpus_query(spark, CORPUS + ";", **{n: view(spark, sf, n) for n in ("lineitem", "orders", "customer")})
