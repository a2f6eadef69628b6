"""Extendible hashing: shards that each fit a byte limit, found from sums per hash prefix alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import without
from querytide.session import staged

SHARD_BYTES = 1 << 20
HASH_BITS = 60
# Prefix bits that one pass over the sums looks at.
STEP_BITS = 12


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of the key as text, as a long; null keys hash as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sums: DataFrame, limit: int) -> DataFrame:
    """The buckets (``depth``, ``prefix``, ``shard_bytes``, ``n_rows``) for ``sums`` (``hash``, ``bytes``, ``n``).

    All begin as one bucket; a bucket over ``limit`` is split on the next bit, others never are. A bucket
    whose rows agree in all bits can't be split and is left at the full depth. Each pass sums ``STEP_BITS``
    further levels at once for the buckets that are still too large, so the work of a pass is one
    pre-aggregated sum over what is left, and most input needs one or two passes.
    """
    found = []
    rest, done = sums, 0
    while done < HASH_BITS:
        levels = range(done, min(done + STEP_BITS, HASH_BITS) + 1)
        fine = F.shiftright("hash", HASH_BITS - levels[-1])
        level = F.explode(F.array(*[F.lit(d) for d in levels]))
        prefix = F.expr(f"shiftright(fine, {levels[-1]} - depth)")
        nodes = (
            rest.groupBy(fine.alias("fine")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
            .select("*", level.alias("depth")).groupBy("depth", prefix.alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_rows"))
        )
        nodes = staged(nodes, "shard-sums")
        split = nodes.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaves = nodes.where(F.col("shard_bytes") <= limit)
        if done:  # the root of a later pass is known to be too large
            leaves = leaves.where(F.col("depth") > done)
        child = leaves.where("depth > 0").withColumn("parent", F.shiftright("prefix", 1))
        found.append(child.join(split, ["depth", "parent"], "left_semi").select(*nodes.columns))
        if not done:
            found.append(leaves.where("depth = 0"))
        over = nodes.where((F.col("depth") == levels[-1]) & (F.col("shard_bytes") > limit))
        done = levels[-1]
        if done == HASH_BITS:
            found.append(over)
            break
        if over.isEmpty():
            break
        rest = staged(rest.withColumn("prefix", F.shiftright("hash", HASH_BITS - done)).join(over.select("prefix"), "prefix", "left_semi").drop("prefix"), "shard-rest")
    return reduce(DataFrame.union, found)


def assign_shards(docs: DataFrame, key_cols: list[str], text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` (without its text) and ``n_bytes``, ``shard_id``, ``depth``, ``shard_bytes``, ``oversized``.

    ``shard_id`` is depth and prefix as ``depth:prefix``. The size of a row is that of its text in UTF-8, 0
    if it is null. The key is hashed with nulls as empty texts; rows with equal keys can't be told apart by
    any hash, so add columns to the key where one key may exceed the limit. ``oversized`` marks what could
    not be split: one row, or rows of one key, above the limit. An empty table has no shard. Extra columns
    stay; those with the names above are replaced.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    rows = without(docs, "n_bytes", "shard_id", "depth", "shard_bytes", "oversized", "hash")
    rows = rows.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "hash": hash_bits(key)}).drop(text_col)
    sums = rows.groupBy("hash").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    shards = staged(directory(sums, limit), "shards").select("depth", "prefix", "shard_bytes")
    # A row meets its shard by (depth, prefix); the few depths in use come from the directory itself.
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most 61 numbers
    if not depths:
        depths = [0]
    at = F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")
    placed = (
        rows.select("hash").distinct().select("hash", at)
        .withColumn("prefix", F.expr(f"shiftright(hash, {HASH_BITS} - depth)"))
        .join(shards, ["depth", "prefix"])
        .select("hash", "depth", "shard_bytes", F.concat_ws(":", F.col("depth").cast("string"), F.col("prefix").cast("string")).alias("shard_id"))
    )
    return rows.join(placed, "hash").drop("hash").withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, key_cols: list[str], path: str, text_col: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write ``docs`` as Parquet, one folder per shard (``shard_id=...``)."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    rows = without(docs, "shard_id", "_hash").withColumn("_hash", hash_bits(key))
    ids = assign_shards(docs, key_cols, text_col, limit).select(hash_bits(key).alias("_hash"), "shard_id").distinct()
    rows.join(ids, "_hash").drop("_hash").repartition("shard_id").write.partitionBy("shard_id").parquet(path)
