"""Roll-ups and features of plan nodes, and catalogue statistics.

Nodes are rows ``(query_idx, node_pos, depth, op_name, table_name, est_*, act_card)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.functions.ordered import with_row_number
from querytide.functions.quantiles import exact_percentiles
from querytide.session import staged

MB = 1024 * 1024


def card(with_width: bool = False, true_card: bool = False) -> Column:
    """Cardinality of a node, times its width if asked; the measured one where there is one."""
    rows = F.coalesce("act_card", "est_card") if true_card else F.col("est_card")
    return rows * F.col("est_width") if with_width else rows


def cardinalities(nodes: DataFrame, with_width: bool = False, true_card: bool = False) -> DataFrame:
    known = F.col("est_card").isNotNull() & F.col("est_width").isNotNull()
    return nodes.where(known).select("query_idx", "node_pos", card(with_width, true_card).alias("card"))


def children_product(nodes: DataFrame) -> DataFrame:
    """Product of the children's cardinalities per node, 1 for a leaf. Needs ``parent_pos``."""
    products = (
        nodes.where(F.col("parent_pos").isNotNull())
        .groupBy("query_idx", F.col("parent_pos").alias("node_pos"))
        .agg(F.product("act_card").alias("_act"), F.product("est_card").alias("_est"))
    )
    return nodes.join(products, ["query_idx", "node_pos"], "left").select(
        "query_idx",
        "node_pos",
        F.coalesce("_act", F.lit(1.0)).alias("act_children_card"),
        F.coalesce("_est", F.lit(1.0)).alias("est_children_card"),
    )


def plan_tables(nodes: DataFrame) -> DataFrame:
    """Distinct tables and operators per plan."""
    return nodes.groupBy("query_idx").agg(
        F.array_sort(F.collect_set("table_name")).alias("tables"),
        F.array_sort(F.collect_set("op_name")).alias("operators"),
    ).withColumn("num_tables", F.size("tables"))


def min_card(nodes: DataFrame) -> DataFrame:
    """Smallest measured cardinality per plan, infinity when nothing was measured."""
    least = F.coalesce(F.min("act_card").cast("double"), F.lit(float("inf")))
    return nodes.groupBy("query_idx").agg(least.alias("min_card"))


def with_table_ids(nodes: DataFrame, table_stats: DataFrame) -> DataFrame:
    """Catalogue number in place of the table name; unknown tables become NULL."""
    ids = table_stats.select(F.col("relname").alias("table_name"), "table_id")
    return nodes.join(ids, "table_name", "left").drop("table_name")


def column_lookup(refs: DataFrame, nodes: DataFrame, column_stats: DataFrame) -> DataFrame:
    """Catalogue number of every referenced column.

    ``refs`` is ``(query_idx, ref_id, alias, column)``. With an alias the table is
    known; a bare name needs exactly one table of the plan to have the column.
    Rows that cannot be resolved keep a NULL number and an ``error``.
    """
    aliases = nodes.where(F.col("alias").isNotNull()).groupBy("query_idx", "alias").agg(
        F.max("table_name").alias("_table")
    )
    stats = column_stats.select(F.col("tablename").alias("_table"), F.col("attname").alias("column"), "column_id")
    in_plan = nodes.where(F.col("table_name").isNotNull()).select("query_idx", F.col("table_name").alias("_table")).distinct()
    # One row per plan and column name, so that bare references never meet all tables.
    by_name = (
        in_plan.join(stats, "_table")
        .groupBy("query_idx", "column")
        .agg(F.count(F.lit(1)).alias("_tables"), F.min("column_id").alias("_bare_id"))
    )
    named = refs.join(aliases, ["query_idx", "alias"], "left")
    named = named.withColumn("_table", F.coalesce("_table", "alias"))
    found = named.join(stats, ["_table", "column"], "left").join(by_name, ["query_idx", "column"], "left")
    bare = F.col("alias").isNull()
    unique = F.coalesce(F.col("_tables") == 1, F.lit(False))
    number = F.when(bare, F.when(unique, F.col("_bare_id"))).otherwise(F.col("column_id"))
    error = (
        F.when(bare & (F.col("_tables") > 1), "ambiguous")
        .when(number.isNull(), "unknown")
    )
    return found.select("query_idx", "ref_id", number.alias("column_id"), error.alias("error"))


def corpus_summary(plans: DataFrame, skipped: int | Column = 0) -> DataFrame:
    """Tables and runtimes over a corpus of plans ``(query_idx, num_tables, runtime_ms)``."""
    measures = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in ("num_tables", "runtime_ms")]
    )
    long = plans.select(F.explode(measures).alias("m")).select("m.*")
    middles = exact_percentiles(long, ["measure"], "v", {"middle": 0.5})
    middle = lambda c: middles.where(F.col("measure") == c).select("middle").scalar()
    return plans.agg(
        F.count(F.lit(1)).alias("parsed"),
        F.avg("num_tables").alias("mean_tables"),
        F.max("num_tables").alias("max_tables"),
        F.avg(F.col("runtime_ms") / 1000).alias("mean_runtime_s"),
        F.max(F.col("runtime_ms") / 1000).alias("max_runtime_s"),
    ).withColumns(
        {
            "median_tables": middle("num_tables"),
            "median_runtime_s": middle("runtime_ms") / 1000,
            "skipped": F.lit(skipped) if isinstance(skipped, int) else skipped,
        }
    )


def filter_operator_share(filters: DataFrame, plans: DataFrame) -> DataFrame:
    """Share of plans with each filter operator; ``filters`` is ``(query_idx, column, operator)``."""
    uses = filters.select("query_idx", "column", "operator").distinct().groupBy("operator").agg(F.count(F.lit(1)).alias("n"))
    total = plans.agg(F.count(F.lit(1))).scalar()
    return uses.select("operator", "n", (F.col("n") / total).alias("share"))


def top_operators(nodes: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent operators, ties by name, and the share all of them cover."""
    counts = nodes.groupBy("op_name").agg(F.count(F.lit(1)).alias("n"))
    total = nodes.agg(F.count("op_name")).scalar()
    best = counts.where(F.col("op_name").isNotNull()).orderBy(F.desc("n"), "op_name").limit(k)
    # At most k rows from here on.
    everything = Window.partitionBy()
    return best.select(
        "op_name",
        "n",
        F.row_number().over(everything.orderBy(F.desc("n"), "op_name")).alias("place"),
        (F.sum("n").over(everything) / total).alias("covered"),
    )


def top_tables(table_stats: DataFrame, k: int = 15) -> DataFrame:
    return table_stats.orderBy(F.desc("reltuples"), "relname").limit(k).select("relname", "table_id", "reltuples")


def plan_features(
    nodes: DataFrame,
    operators: Sequence[str],
    table_sizes: Sequence[tuple[str, float]] = (),
    with_width: bool = False,
    use_log: bool = True,
    true_card: bool = False,
    selectivity: bool = False,
) -> DataFrame:
    """``features`` per plan: count and summed cardinality per listed operator, then the
    summed cardinality (or share of the table, at most 1) per listed table.

    Only nodes of the listed operators count. Sums become ``max(ln(x + 1e-5), 0)``
    or, without ``use_log``, mega units. One grouping with conditional sums; the
    lists are short by construction.
    """
    size = card(with_width, true_card).cast("double")
    known = nodes.where(F.col("op_name").isin(list(operators)))

    def scaled(total: Column) -> Column:
        total = F.coalesce(total, F.lit(0.0))
        return F.greatest(F.log(total + 1e-5), F.lit(0.0)) if use_log else total / 1024 / 1024

    parts = []
    for op in operators:
        here = F.col("op_name") == op
        parts += [scaled(F.sum(here.cast("double"))), scaled(F.sum(F.when(here, size)))]
    for name, reltuples in table_sizes:
        here = F.col("table_name") == name
        if selectivity:
            share = F.sum(F.when(here, card(False, true_card).cast("double") / reltuples))
            parts.append(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)))
        else:
            parts.append(scaled(F.sum(F.when(here, size))))
    return known.groupBy("query_idx").agg(F.array(*parts).alias("features"))


def memory_estimate(
    nodes: DataFrame, operators: Sequence[str], with_width: bool = True, true_card: bool = False
) -> DataFrame:
    """Largest intermediate result of the listed operators in mega units."""
    known = nodes.where(F.col("op_name").isin(list(operators)))
    return known.groupBy("query_idx").agg((F.max(card(with_width, true_card)) / 1024 / 1024).alias("memory_mb"))


def table_sizes(column_stats: DataFrame, table_stats: DataFrame) -> DataFrame:
    """Size per catalogue table in MB: positive column widths times rows."""
    widths = column_stats.groupBy(F.col("tablename").alias("relname")).agg(
        F.sum(F.when(F.col("avg_width") > 0, F.col("avg_width")).otherwise(0)).alias("_width")
    )
    return widths.join(table_stats, "relname").select(
        "relname", "table_id", (F.col("reltuples") * F.col("_width") / MB).alias("size_mb")
    )


def scan_mb(
    nodes: DataFrame,
    column_stats: DataFrame,
    true_card: bool = False,
    output_columns: DataFrame | None = None,
) -> DataFrame:
    """Data scanned per query and table in MB.

    A row store reads all columns of a table. For a column store pass the columns
    each scan puts out, ``(query_idx, node_pos, column_id)``.
    """
    scans = nodes.where(F.col("table_name").isNotNull())
    rows = F.coalesce("act_card", "est_card") if true_card else F.col("est_card")
    if output_columns is None:
        widths = column_stats.groupBy(F.col("tablename").alias("table_name")).agg(F.sum("avg_width").alias("_width"))
        joined = scans.join(widths, "table_name")
    else:
        widths = (
            output_columns.join(column_stats.select("column_id", "avg_width"), "column_id")
            .groupBy("query_idx", "node_pos")
            .agg(F.sum("avg_width").alias("_width"))
        )
        joined = scans.join(widths, ["query_idx", "node_pos"], "left")
    width = F.coalesce("_width", F.lit(0))
    return joined.groupBy("query_idx", "table_name").agg((F.sum(rows * width) / MB).alias("scan_mb"))


# Bytes of the types that have one width.
_WIDTHS = {"int": 4, "bigint": 8, "double": 8, "float": 4, "date": 4, "timestamp": 8, "timestamp_ntz": 8, "boolean": 1}


def profile_tables(tables: Mapping[str, tuple[DataFrame, str]], approximate: bool = False) -> DataFrame:
    """Catalogue statistics per table and column: data type, share of NULLs, average width, number of distinct values, and
    the correlation of value order with row order.

    ``tables`` gives each table with the column of its unique physical position. All columns of all tables are put in order at
    once, as rows (table, column, value), so neither a column nor a table is a job or a task of its own.
    """
    basics, texts, values = [], [], []
    for name, (table, order) in tables.items():
        kinds = dict(table.dtypes)
        # A table in few files would be unfolded and ordered by as few tasks.
        table = staged(table.repartition(order), "profiled")
        named = lambda c, *more: F.struct(F.lit(name).alias("tablename"), F.lit(c).alias("attname"), *more)  # noqa: E731, B023
        width = lambda c: F.avg(F.octet_length(c)) if kinds[c] == "string" else F.lit(float(_WIDTHS[kinds[c]]))  # noqa: E731, B023
        entries = [
            named(
                c,
                F.lit(kinds[c]).alias("data_type"),
                F.avg(F.col(c).isNull().cast("double")).alias("null_frac"),
                width(c).alias("avg_width"),
                (F.approx_count_distinct(c) if approximate else F.lit(None).cast("bigint")).alias("_approx"),
            )
            for c in kinds
        ]
        basics.append(table.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*"))
        written = F.array(*[named(c, F.col(c).cast("string").alias("v")) for c in kinds])
        texts.append(table.select(F.explode(written).alias("_v")).select("_v.*").where("v is not null"))

        def value(c: str) -> Column:
            whole = F.lit(None).cast("bigint")
            if kinds[c] in ("int", "bigint", "smallint", "tinyint", "boolean"):  # noqa: B023
                whole = F.col(c).cast("bigint")
            elif kinds[c] in ("date", "timestamp", "timestamp_ntz"):  # noqa: B023
                whole = F.unix_micros(F.col(c).cast("timestamp"))
            real = F.col(c).cast("double") if kinds[c] in ("double", "float") else F.lit(None).cast("double")  # noqa: B023
            text = F.when(whole.isNull() & real.isNull(), F.col(c).cast("string"))
            return named(c, whole.alias("_whole"), real.alias("_real"), text.alias("_text"), F.col(order).alias("_p"))  # noqa: B023

        given = F.coalesce("_whole", "_real").isNotNull() | F.col("_text").isNotNull()
        values.append(table.select(F.explode(F.array(*[value(c) for c in kinds])).alias("_v")).select("_v.*").where(given))
    stacked = lambda parts: reduce(DataFrame.unionByName, parts)
    keys, basics = ["tablename", "attname"], stacked(basics)
    if approximate:
        distinct = basics.select(*keys, F.col("_approx").alias("n_distinct"))
    else:
        # Values merge map-side under their own key first, so no column is one task.
        distinct = stacked(texts).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    ranked = with_row_number(stacked(values), keys, ["_whole", "_real", "_text", "_p"], "_rank")
    orders = ranked.groupBy(*keys).agg(F.corr("_rank", "_p").alias("correlation"))
    return basics.drop("_approx").join(distinct, keys, "left").join(orders, keys, "left")


def profile_columns(table: DataFrame, order: str, approximate: bool = False) -> DataFrame:
    """``profile_tables`` of one table, without its name."""
    return profile_tables({"": (table, order)}, approximate).drop("tablename")
