"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

For each of ``SLOTS`` samples and each word of weight w (its count), with r and c from a gamma(2, 1) distribution and
b uniform, all functions of word and sample: t = floor(ln w / r + b), and ln a = ln c - r (t - b + 1). The
word with the smallest a gives the slot, as (word, t). Two documents agree in a slot with a probability equal to the
generalised Jaccard similarity of their weights, sum of minima over sum of maxima.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 40
LANE = 8
# The gamma variates are read from tables of so many quantiles.
QUANTILES = 4096
_BITS = QUANTILES.bit_length() - 1
WORD = r"[ \t\n\x0b\f\r]+"
# Blocks of neighbouring ids per shuffle partition.
BLOCKS = 4


def gamma_quantiles(n: int = QUANTILES) -> list[float]:
    """Midpoint quantiles of the gamma(2, 1) distribution, 1 - (1 + x) exp(-x), by bisection."""
    out = []
    for i in range(n):
        p, low, high = (i + 0.5) / n, 0.0, 40.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if 1 - (1 + middle) * math.exp(-middle) < p else (low, middle)
        out.append((low + high) / 2)
    return out


def constant(values: list[float]) -> Column:
    """An array that the optimizer folds to one literal."""
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)")


def sample(word: Column, log_weight: Column, k: Column, r_table: Column, c_table: Column) -> Column:
    """The word's entry for slot ``k``: ln a in the high bits, (word, t) in the 20 low ones, so that a minimum picks the sample."""
    h = F.xxhash64(word, k)
    r = r_table[(h.bitwiseAND(QUANTILES - 1)).cast("int")]
    log_c = c_table[F.shiftright(h, _BITS).bitwiseAND(QUANTILES - 1).cast("int")]
    b = (F.shiftright(h, 2 * _BITS).bitwiseAND(0xFFFF) + 0.5) / 65536.0
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1.0)
    high = F.shiftleft(((log_a + 2000.0) * F.lit(float(1 << 30))).cast("long"), 20)
    return high.bitwiseOR(F.shiftright(h, 2 * _BITS + 16).bitwiseXOR(t).bitwiseAND(0xFFFFF))


def signatures(texts: DataFrame, keys: list[str], text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``keys`` and ``sig`` (array of ``slots`` longs) per distinct ``keys``; texts without words are alike;
    ``slots`` is a multiple of ``LANE``.

    Both groupings are by all of ``keys``, so where the input is dealt by some of them nothing is shuffled.
    """
    quantiles = gamma_quantiles()
    r_table, c_table = constant(quantiles), constant([math.log(q) for q in quantiles])
    # A text without words has one word of its own, which no other text has: its null hashes to a fixed number.
    words = F.array_remove(F.split(F.coalesce(text_col, F.lit("")), WORD), "")
    words = texts.select(*keys, F.explode_outer(words).alias("word")).select(*keys, F.xxhash64("word").alias("word"))
    weighted = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    weighted = weighted.select(*keys, "word", F.coalesce(F.log(F.col("n").cast("double")), F.lit(0.0)).alias("lw"))
    # A row is taken once for each lane of a few slots: code for all slots at once is too long for the JVM to compile.
    lanes = weighted.select(*keys, "word", "lw", F.explode(F.sequence(F.lit(0), F.lit(slots // LANE - 1))).alias("lane"))
    picks = [F.min(sample(F.col("word"), F.col("lw"), F.col("lane") * LANE + k, r_table, c_table)).alias(f"s{k}") for k in range(LANE)]
    parts = lanes.groupBy(*keys, "lane").agg(*picks).select(*keys, F.struct("lane", F.array(*[f"s{k}" for k in range(LANE)]).alias("s")).alias("part"))
    parts = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # slots / LANE entries
    return parts.select(*keys, F.flatten(F.transform("parts", lambda p: p["s"])).alias("sig"))


def fingerprint(sig: Column) -> Column:
    """Five hex digits a slot."""
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(0xFFFFF))), 5, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of slots in which two signatures agree; 1 for two texts without words."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)
    return F.size(same) / F.size(a).cast("double")


def _blocks(docs: DataFrame, id_col: str) -> tuple[list, dict[int, object]]:
    """Ids that cut the ascending ids into blocks, and the first id of every block that has rows. Both are as many as blocks."""
    spark = docs.sparkSession
    n = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    firsts = ids.where("id IS NOT NULL").groupBy(block_of(F.col("id"), cuts).alias("block")).agg(F.min("id").alias("id")).collect()
    return cuts, {b: i for b, i in firsts}


def block_of(doc: Column, cuts: list) -> Column:
    """How many cuts are at or below the id, by a search over every s-th cut and one over s cuts; 0 for null."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    every = F.array(*[F.lit(c) for c in cuts])
    coarse = F.array(*[F.lit(c) for c in cuts[::step]])
    reached = F.size(F.filter(coarse, lambda c: c <= doc))
    begin = F.greatest(reached - 1, F.lit(0)) * step
    return F.coalesce(begin + F.size(F.filter(F.slice(every, begin + 1, step), lambda c: c <= doc)), F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``block``, ``at``, ``extra``, ``doc``, ``text``, ``next_text``) in ascending order of (id, text), the first after the last.

    Ids are cut into blocks; the rows of a block's first id are also put, as ``extra`` rows, behind the block
    before, so that every row finds its successor inside its block and texts are shuffled once.
    """
    cuts, firsts = _blocks(docs, id_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("block", block_of(F.col("doc"), cuts))
    held = sorted(firsts)
    before = {firsts[b]: held[i - 1] for i, b in enumerate(held)}  # of the first block the last one
    if before:
        pairs = [x for i, b in before.items() for x in (F.lit(i), F.lit(b))]
        extra = rows.where(F.col("doc").isin(list(before))).withColumn("block", F.create_map(*pairs)[F.col("doc")])
        rows = rows.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))
    else:
        rows = rows.withColumn("extra", F.lit(0))
    order = Window.partitionBy("block").orderBy("extra", "doc", "text")
    return rows.withColumns({"at": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def edited_pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, edited: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars``, ``edited``, both signatures and that of the next document.

    ``edited`` is the edited text, or what the given function makes of it before rows are joined with signatures.

    The edited text is the text with its last floor(n / 2) code points replaced by as many first ones of the next
    document (all, if it has fewer). A null text is an empty one. Rows that share an id follow each other by text;
    null ids come first. A single row is its own successor. An empty table gives no rows. Other columns are left out.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # Only one row in the table: nothing follows it.
    following = F.coalesce("next_text", "text")
    rows = rows.withColumns({
        "n_chars": n.cast("long"),
        "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring(following, F.lit(1), half)),
    })
    both = rows.select("block", "at", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))
    )).alias("s")).select("block", "at", "s.side", "s.text")
    sigs = signatures(both, ["block", "at", "side"], slots=slots)
    sigs = sigs.groupBy("block", "at").agg(
        F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("sig"), F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("edited_sig")
    )
    order = Window.partitionBy("block").orderBy("at")
    sigs = sigs.withColumn("next_sig", F.coalesce(F.lead("sig").over(order), "sig"))
    joined = rows.select("block", "at", "extra", "doc", "n_chars", edited(F.col("edited")).alias("edited")).join(sigs, ["block", "at"])
    return joined.where("extra = 0").select(F.col("doc").alias(id_col), "n_chars", "edited", "sig", "edited_sig", "next_sig")
