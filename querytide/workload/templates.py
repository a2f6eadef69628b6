"""The 22 decision-support templates as DataFrame jobs.

Each takes the tables it reads and its binds. Tables have the columns at hand:
where one is missing (containers, ship modes, phones, receipt dates) the bind
that stands in for it is named in the docstring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day(text: str) -> Column:
    """A date bind in the type of the tables, so that it reaches the scan."""
    return F.lit(text).cast("timestamp_ntz")


def _later(text: str, **span: int) -> Column:
    return day(text) + F.make_interval(**{k: F.lit(v) for k, v in span.items()})


def _volume() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def q01(lineitem: DataFrame, days: int = 90) -> DataFrame:
    rows = lineitem.where(F.col("l_shipdate") <= _later("1998-12-01", days=-days))
    return (
        rows.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base_price"),
            F.sum(_volume()).alias("sum_disc_price"),
            F.sum(_volume() * (1 + F.col("l_tax"))).alias("sum_charge"),
            F.avg("l_quantity").alias("avg_qty"),
            F.avg("l_extendedprice").alias("avg_price"),
            F.avg("l_discount").alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _region_suppliers(supplier, nation, region, name) -> DataFrame:
    inside = nation.join(region.where(F.col("r_name") == name), F.col("n_regionkey") == F.col("r_regionkey"))
    return supplier.join(inside, F.col("s_nationkey") == F.col("n_nationkey"))


def q02(part, supplier, partsupp, nation, region, size: int = 10, kind: str = "LL", name: str = "EUROPE") -> DataFrame:
    """Cheapest supplier of a region per part; ``size`` is an upper bound."""
    parts = part.where((F.col("p_size") <= size) & F.col("p_type").like(f"%{kind}"))
    offers = (
        partsupp.join(parts, F.col("ps_partkey") == F.col("p_partkey"))
        .join(_region_suppliers(supplier, nation, region, name), F.col("ps_suppkey") == F.col("s_suppkey"))
    )
    least = offers.groupBy("ps_partkey").agg(F.min("ps_supplycost").alias("_least")).withColumnRenamed("ps_partkey", "_part")
    best = offers.join(least, (F.col("ps_partkey") == F.col("_part")) & (F.col("ps_supplycost") == F.col("_least")))
    return best.select("s_acctbal", "s_name", "n_name", "p_partkey", "p_name").orderBy(
        F.desc("s_acctbal"), "n_name", "s_name", "p_partkey"
    )


def q03(customer, orders, lineitem, segment: str = "BUILDING", date: str = "1998-03-15") -> DataFrame:
    buyers = customer.where(F.col("c_mktsegment") == segment)
    before = orders.where(F.col("o_orderdate") < day(date))
    after = lineitem.where(F.col("l_shipdate") > day(date))
    joined = before.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(
        after, F.col("o_orderkey") == F.col("l_orderkey")
    )
    return (
        joined.groupBy("l_orderkey", "o_orderdate")
        .agg(F.sum(_volume()).alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate")
    )


def q04(orders, lineitem, date: str = "1998-01-01", days: int = 30) -> DataFrame:
    """Orders of a quarter with a line shipped within ``days`` of the order."""
    quarter = orders.where((F.col("o_orderdate") >= day(date)) & (F.col("o_orderdate") < _later(date, months=3)))
    soon = F.col("l_shipdate") < F.col("o_orderdate") + F.make_interval(days=F.lit(days))
    checked = quarter.join(lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & soon, "left_semi")
    return checked.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


def q05(customer, orders, lineitem, supplier, nation, region, name: str = "ASIA", date: str = "1996-01-01") -> DataFrame:
    year = orders.where((F.col("o_orderdate") >= day(date)) & (F.col("o_orderdate") < _later(date, years=1)))
    local = (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    joined = (
        year.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_region_suppliers(supplier, nation, region, name), local)
    )
    return joined.groupBy("n_name").agg(F.sum(_volume()).alias("revenue")).orderBy(F.desc("revenue"))


def q06(lineitem, date: str = "1996-01-01", discount: float = 0.06, quantity: float = 24) -> DataFrame:
    rows = lineitem.where(
        (F.col("l_shipdate") >= day(date))
        & (F.col("l_shipdate") < _later(date, years=1))
        & F.col("l_discount").between(round(discount - 0.01, 2), round(discount + 0.01, 2))
        & (F.col("l_quantity") < quantity)
    )
    return rows.agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


def q07(
    supplier, lineitem, orders, customer, nation, first: str = "NATION_1", second: str = "NATION_2",
    low: str = "1996-01-01", high: str = "1999-12-31",
) -> DataFrame:
    either = nation.where(F.col("n_name").isin(first, second))
    supp = either.select(F.col("n_nationkey").alias("_sn"), F.col("n_name").alias("supp_nation"))
    cust = either.select(F.col("n_nationkey").alias("_cn"), F.col("n_name").alias("cust_nation"))
    sellers = supplier.join(supp, F.col("s_nationkey") == F.col("_sn"))
    buyers = customer.join(cust, F.col("c_nationkey") == F.col("_cn"))
    joined = (
        lineitem.where(F.col("l_shipdate").between(day(low), day(high)))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .where(F.col("supp_nation") != F.col("cust_nation"))
    )
    keys = ["supp_nation", "cust_nation", "l_year"]
    return (
        joined.withColumn("l_year", F.year("l_shipdate")).groupBy(*keys).agg(F.sum(_volume()).alias("revenue")).orderBy(*keys)
    )


def q08(
    part, supplier, lineitem, orders, customer, nation, region, national: str = "NATION_3", name: str = "EUROPE",
    kind: str = "ECONOMY", low: str = "1996-01-01", high: str = "1998-12-31",
) -> DataFrame:
    home = nation.join(region.where(F.col("r_name") == name), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = customer.join(home.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    sellers = supplier.join(
        nation.select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("_nation")), F.col("s_nationkey") == F.col("_n")
    )
    joined = (
        lineitem.join(part.where(F.col("p_type") == kind), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.where(F.col("o_orderdate").between(day(low), day(high))), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    own = F.when(F.col("_nation") == national, _volume()).otherwise(0.0)
    return (
        joined.groupBy(F.year("o_orderdate").alias("o_year"))
        .agg((F.sum(own) / F.sum(_volume())).alias("mkt_share"))
        .orderBy("o_year")
    )


def q09(part, supplier, lineitem, partsupp, orders, nation, word: str = "small") -> DataFrame:
    parts = part.where(F.col("p_name").contains(word))
    sellers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(partsupp, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey")))
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    amount = _volume() - F.col("ps_supplycost") * F.col("l_quantity")
    return (
        joined.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").alias("o_year"))
        .agg(F.sum(amount).alias("sum_profit"))
        .orderBy("nation", F.desc("o_year"))
    )


def q10(customer, orders, lineitem, nation, date: str = "1996-10-01") -> DataFrame:
    """Revenue is summed per customer key before names are attached."""
    quarter = orders.where((F.col("o_orderdate") >= day(date)) & (F.col("o_orderdate") < _later(date, months=3)))
    returned = lineitem.where(F.col("l_returnflag") == "R")
    revenue = (
        quarter.join(returned, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum(_volume()).alias("revenue"))
    )
    named = revenue.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return named.select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.desc("revenue"))


def q11(partsupp, supplier, nation, name: str = "NATION_4", fraction: float = 0.001) -> DataFrame:
    inside = supplier.join(nation.where(F.col("n_name") == name), F.col("s_nationkey") == F.col("n_nationkey"))
    stock = partsupp.join(inside, F.col("ps_suppkey") == F.col("s_suppkey"))
    value = F.sum(F.col("ps_supplycost") * F.col("ps_availqty"))
    total = stock.agg(value * fraction).scalar()
    return stock.groupBy("ps_partkey").agg(value.alias("value")).where(F.col("value") > total).orderBy(F.desc("value"))


def q12(orders, lineitem, modes: Sequence[str] = ("A", "R"), date: str = "1997-01-01") -> DataFrame:
    """``modes`` are return flags in place of ship modes; shipped after the order, in one year."""
    rows = lineitem.where(
        F.col("l_returnflag").isin(*modes) & (F.col("l_shipdate") >= day(date)) & (F.col("l_shipdate") < _later(date, years=1))
    )
    joined = rows.join(
        orders, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") < F.col("l_shipdate"))
    )
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("bigint")
    return (
        joined.groupBy("l_returnflag")
        .agg(F.sum(urgent).alias("high_line_count"), F.sum(1 - urgent).alias("low_line_count"))
        .orderBy("l_returnflag")
    )


def q13(customer, orders, word: str = "SPEC") -> DataFrame:
    """Orders are counted per customer before the outer join."""
    counted = (
        orders.where(~F.col("o_orderpriority").like(f"%{word}%"))
        .groupBy("o_custkey")
        .agg(F.count("o_orderkey").alias("_n"))
    )
    per_customer = customer.join(counted, F.col("c_custkey") == F.col("o_custkey"), "left")
    return (
        per_customer.groupBy(F.coalesce("_n", F.lit(0)).alias("c_count"))
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(F.desc("custdist"), F.desc("c_count"))
    )


def q14(lineitem, part, date: str = "1997-09-01") -> DataFrame:
    month = lineitem.where((F.col("l_shipdate") >= day(date)) & (F.col("l_shipdate") < _later(date, months=1)))
    joined = month.join(part, F.col("l_partkey") == F.col("p_partkey"))
    promo = F.when(F.startswith("p_type", F.lit("PROMO")), _volume()).otherwise(0.0)
    return joined.agg((100.0 * F.sum(promo) / F.sum(_volume())).alias("promo_revenue"))


def q15(lineitem, supplier, date: str = "1997-01-01") -> DataFrame:
    quarter = lineitem.where((F.col("l_shipdate") >= day(date)) & (F.col("l_shipdate") < _later(date, months=3)))
    # Rounded, so that both readings of the sums compare equal.
    revenue = quarter.groupBy(F.col("l_suppkey").alias("supplier_no")).agg(F.round(F.sum(_volume()), 4).alias("total_revenue"))
    top = revenue.where(F.col("total_revenue") == revenue.agg(F.max("total_revenue")).scalar())
    joined = supplier.join(top, F.col("s_suppkey") == F.col("supplier_no"))
    return joined.select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


def q16(
    partsupp, part, supplier, brand: str = "Brand#5", kind: str = "MEDIUM", sizes: Sequence[int] = (3, 9, 14, 19, 23, 36, 45, 49),
    below: float = 0,
) -> DataFrame:
    """Suppliers with a balance under ``below`` stand in for those with complaints."""
    parts = part.where(
        (F.col("p_brand") != brand) & ~F.startswith("p_type", F.lit(kind)) & F.col("p_size").isin(*sizes)
    )
    bad = supplier.where(F.col("s_acctbal") < below).select(F.col("s_suppkey").alias("_bad"))
    offers = partsupp.join(parts, F.col("ps_partkey") == F.col("p_partkey")).join(
        bad, F.col("ps_suppkey") == F.col("_bad"), "left_anti"
    )
    keys = ["p_brand", "p_type", "p_size"]
    return (
        offers.groupBy(*keys).agg(F.countDistinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), *keys)
    )


def q17(lineitem, part, brand: str = "Brand#3", size: int = 25) -> DataFrame:
    """Parts under ``size`` stand in for a container."""
    parts = part.where((F.col("p_brand") == brand) & (F.col("p_size") < size)).select("p_partkey")
    rows = lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    small = rows.groupBy(F.col("l_partkey").alias("_part")).agg((0.2 * F.avg("l_quantity")).alias("_limit"))
    few = rows.join(small, F.col("l_partkey") == F.col("_part")).where(F.col("l_quantity") < F.col("_limit"))
    return few.agg((F.sum("l_extendedprice") / 7.0).alias("avg_yearly"))


def q18(customer, orders, lineitem, quantity: float = 250) -> DataFrame:
    """Line sums per order serve the filter and the result."""
    large = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).where(F.col("sum_qty") > quantity)
    joined = large.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty").orderBy(
        F.desc("o_totalprice"), "o_orderdate"
    )


def q19(
    lineitem, part, brands: Sequence[str] = ("Brand#1", "Brand#2", "Brand#3"), quantities: Sequence[int] = (1, 10, 20),
    sizes: Sequence[int] = (15, 30, 45), modes: Sequence[str] = ("A", "N"),
) -> DataFrame:
    """The common key is taken out of the three blocks; flags stand in for modes and containers."""
    joined = lineitem.where(F.col("l_returnflag").isin(*modes)).join(part, F.col("l_partkey") == F.col("p_partkey"))
    wanted = F.lit(False)
    for brand, low, size in zip(brands, quantities, sizes):
        wanted = wanted | (
            (F.col("p_brand") == brand) & F.col("l_quantity").between(low, low + 10) & F.col("p_size").between(1, size)
        )
    return joined.where(wanted).agg(F.sum(_volume()).alias("revenue"))


def q20(
    supplier, nation, partsupp, part, lineitem, word: str = "small", date: str = "1997-01-01",
    names: Sequence[str] = ("NATION_1", "NATION_2"),
) -> DataFrame:
    parts = part.where(F.startswith("p_name", F.lit(word))).select("p_partkey")
    year = lineitem.where((F.col("l_shipdate") >= day(date)) & (F.col("l_shipdate") < _later(date, years=1)))
    sold = (
        year.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_partkey", "l_suppkey")
        .agg((0.5 * F.sum("l_quantity")).alias("_half"))
    )
    stocked = partsupp.join(
        sold,
        (F.col("ps_partkey") == F.col("l_partkey"))
        & (F.col("ps_suppkey") == F.col("l_suppkey"))
        & (F.col("ps_availqty") > F.col("_half")),
    )
    inside = supplier.join(nation.where(F.col("n_name").isin(*names)), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        inside.join(stocked, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").select("s_name").orderBy("s_name")
    )


def q21(supplier, lineitem, orders, nation, name: str = "NATION_5", days: int = 60) -> DataFrame:
    """Suppliers that alone were late in an order of several. A line is late ``days`` after the order.

    An order qualifies when it has two suppliers or more and one late supplier, which
    four extremes per order tell: one grouping in place of a semi and an anti join.
    """
    joined = lineitem.join(orders.where(F.col("o_orderstatus") == "F"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.make_interval(days=F.lit(days))
    late_supplier = F.when(late, F.col("l_suppkey"))
    per_order = joined.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("_a"),
        F.max("l_suppkey").alias("_b"),
        F.min(late_supplier).alias("_late"),
        F.max(late_supplier).alias("_late_b"),
        F.count(late_supplier).alias("_lines"),
    )
    alone = per_order.where((F.col("_a") < F.col("_b")) & (F.col("_late") == F.col("_late_b")))
    waits = alone.groupBy("_late").agg(F.sum("_lines").alias("numwait"))
    inside = supplier.join(nation.where(F.col("n_name") == name), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        inside.join(waits, F.col("s_suppkey") == F.col("_late"))
        .select("s_name", "numwait")
        .orderBy(F.desc("numwait"), "s_name")
    )


def q22(customer, orders, codes: Sequence[int] = (1, 3, 7, 9, 13, 17, 23), since: str = "2000-06-01") -> DataFrame:
    """Nation keys stand in for phone prefixes; customers without an order since a date."""
    inside = customer.where(F.col("c_nationkey").isin(*codes))
    mean = inside.where(F.col("c_acctbal") > 0).agg(F.avg("c_acctbal")).scalar()
    rich = inside.where(F.col("c_acctbal") > mean)
    recent = orders.where(F.col("o_orderdate") >= day(since))
    idle = rich.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return (
        idle.groupBy(F.col("c_nationkey").alias("cntrycode"))
        .agg(F.count(F.lit(1)).alias("numcust"), F.sum("c_acctbal").alias("totacctbal"))
        .orderBy("cntrycode")
    )
