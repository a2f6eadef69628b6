"""Star joins: a chain of left outer joins from a fact table, filters, and one aggregation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def star(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """``dimensions`` are ``(table, key on the rows so far, key of the table)``, joined in order.

    Filters on a dimension may follow: where one rejects NULLs, the optimizer turns
    its outer join into an inner one and moves the filter to the scan.
    """
    rows = fact
    for table, mine, theirs in dimensions:
        rows = rows.join(table, rows[mine] == table[theirs], "left")
    return rows


def star_aggregate(
    rows: DataFrame, aggregates: Mapping[str, Column], where: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    kept = rows if where is None else rows.where(where)
    result = kept.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return result.orderBy(*by) if by else result


def corpus_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run one text of a star-join corpus over the given tables: names in double quotes are
    identifiers, a closing semicolon is dropped."""
    text = re.sub(r'"(\w+)"', r"`\1`", sql.strip().rstrip(";"))
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(text)
