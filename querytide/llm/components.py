"""Connected components of a link table that no hub can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.session import staged


def _lowest(links: DataFrame, label: str) -> DataFrame:
    """Per ``a`` the smallest ``b``. Written out, so that the join with it is one that skewed keys can be split in."""
    return staged(links.groupBy("a").agg(F.min("b").alias("low")), label)


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (two columns), ``component`` being the smallest node reached.

    Alternates two steps until nothing changes: every larger neighbour, then every smaller one, is hung on the
    smallest neighbour. The number of rounds grows with the logarithm of the number of nodes. Links to
    itself and repeated links do no harm; a link with a null end is none. Without links there are no rows.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    links = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = staged(links.distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        before = tuple(state)
        both = links.union(links.select("b", "a"))
        low = _lowest(both, "large")
        links = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        links = staged(links.distinct(), "links")
        low = _lowest(links, "small")
        small = links.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("x"), F.col("low").alias("y")), F.struct(F.col("b").alias("x"), F.col("low").alias("y"))
        )).alias("s"))
        links = staged(small.select(F.col("s.x").alias("a"), F.col("s.y").alias("b")).where("a != b").distinct(), "links")
