"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one vector kept per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.components import components
from querytide.session import staged

SIMILARITY = 0.9
# The centroids are fitted on so many vectors at most, chosen by hash; every vector is assigned and compared.
SAMPLE_VECTORS = 16384
ROUNDS = 6
# Centroids number the square root of the vectors over this: with fewer cells fewer borders are near, and fewer copies are sent.
CELL_SHARE = 64
# Vectors of a block, and how many of them are compared with the other block at once.
BLOCK = 8192
TILE = 512
# Vectors whose cosines with all centroids are held at once.
PASS_ROWS = 256


def margin(similarity: float) -> float:
    """How near a cell's border has to be for a vector to be looked up in that cell.

    A vector lives in the cell of its nearest centroid. The distances of two vectors from the border between their cells
    add up to no more than the vectors' own distance, so one of them is no further from it than half of that: every pair
    with the cosine asked for meets. A little is added for rounding.
    """
    return math.sqrt(max(0.0, 2 - 2 * similarity)) / 2 + 1e-6


def unit_vectors(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are usable, and those as unit vectors in double precision."""
    usable, out = [], []
    for v in column:
        v = None if v is None else np.asarray(v, np.float64)
        norm = 0.0 if v is None or not len(v) else float(np.linalg.norm(v))
        usable.append(bool(0 < norm < math.inf))  # NaN and infinite components fail here as well
        out.append(v / norm if usable[-1] else v)
    return np.array(usable, bool), out


def units_of(column) -> np.ndarray:
    """Usable vectors of one length as rows of unit length."""
    whole = np.array(column.tolist(), np.float64)
    return whole / np.linalg.norm(whole, axis=1, keepdims=True)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest centroid of each vector, and the cosine with it."""
    own, cosine = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    for t in range(0, len(vectors), PASS_ROWS):
        near = vectors[t : t + PASS_ROWS] @ centroids.T
        own[t : t + PASS_ROWS] = near.argmax(axis=1)
        cosine[t : t + PASS_ROWS] = near.max(axis=1)
    return own, cosine


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids; an empty cell takes a vector far from its own centroid."""
    draw = np.random.default_rng(seed)
    centroids = vectors[draw.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        own, cosine = nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(norms < 1e-12)
        sums[lost] = vectors[np.argsort(cosine)[: len(lost)]]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def fit_cells(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centroids per dimension, about the square root of its vectors over ``CELL_SHARE`` (a quarter of the sample at most), from a bounded sample chosen by hash."""
    sample = vectors.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE_VECTORS).select("v").toPandas()["v"]
    cells = {}
    for size, own in sample.groupby(sample.map(len)):
        share = math.isqrt(n * len(own) // len(sample) // CELL_SHARE)
        cells[size] = spherical_kmeans(units_of(own), max(1, min(share, len(own) // 4)))
    return cells


def _assigned(cells, similarity: float):
    """Per vector the cell it lives in and those it is looked up in, its own among them; vectors of a dimension without centroids share one cell."""
    def run(frames):
        known, reach = cells.value, margin(similarity)
        for pdf in frames:
            for size, whole in pdf.groupby(pdf["v"].map(len)):
                for begin in range(0, len(whole), PASS_ROWS):
                    part = whole.iloc[begin : begin + PASS_ROWS]
                    home, close = np.zeros(len(part), np.int64), np.ones((len(part), 1), bool)
                    if size in known:
                        near = units_of(part["v"]) @ known[size].T
                        home = near.argmax(axis=1)
                        gaps = np.sqrt(np.maximum(2 - 2 * known[size][home] @ known[size].T, 1e-12))
                        close = (near.max(axis=1, keepdims=True) - near) / gaps <= reach
                        close[np.arange(len(home)), home] = True
                    yield part.assign(size=size, home=home, cells=[np.flatnonzero(c) for c in close])[["size", "home", "cells", "vec", "n", "v"]]

    return run


def _compared(similarity: float):
    """Links between vectors that live in a cell and vectors looked up there, without listing pairs: per vector the number, and the smallest vector it is joined with here."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"vec": [], "links": [], "low": []})
        left, right = pdf[pdf["cells"].notna()], pdf[pdf["cells"].isna()]
        if not len(left) or not len(right):
            return nothing
        cell = int(pdf["cell"].iloc[0])
        own, units = units_of(left["v"]), units_of(right["v"]).T
        ids = [part["vec"].to_numpy(np.int64) for part in (left, right)]
        # Of two vectors that live here the smaller one is the looked up one's partner.
        inside = np.flatnonzero(right["home"].to_numpy() == cell)
        hit = np.zeros((len(left), len(right)), bool)
        for t in range(0, len(left), TILE):
            hit[t : t + TILE] = own[t : t + TILE] @ units >= similarity
            hit[t : t + TILE, inside] &= ids[0][t : t + TILE, None] < ids[1][inside]
        # Only vectors with a link go on.
        rows, columns = hit.any(axis=1), hit.any(axis=0)
        left, right, hit = left[rows], right[columns], hit[rows][:, columns]
        ids = [ids[0][rows], ids[1][columns]]
        tiles = range(0, len(left), TILE)
        # A pair that meets in the cells of both counts in the lower of the two.
        homes, at = np.unique(right["home"].to_numpy(), return_inverse=True)
        counts_here = np.ones((len(left), len(homes)), bool)
        for i, cells in enumerate(left["cells"]):
            counts_here[i] = (homes >= cell) | ~np.isin(homes, cells)
        for t in tiles:
            hit[t : t + TILE] &= counts_here[t : t + TILE][:, at]
        if not hit.any():
            return nothing
        weights = [part["n"].to_numpy(np.int64) for part in (left, right)]
        links = [
            np.concatenate([hit[t : t + TILE] @ weights[1] for t in tiles]),
            sum(weights[0][t : t + TILE] @ hit[t : t + TILE] for t in tiles),
        ]
        low = ids
        none = np.iinfo(np.int64).max
        while True:  # the smallest vector wanders along the links of the block
            new_left, new_right = low[0].copy(), low[1].copy()
            for t in tiles:
                here = slice(t, t + TILE)
                new_left[here] = np.minimum(low[0][here], np.where(hit[here], low[1][None, :], none).min(axis=1))
                new_right = np.minimum(new_right, np.where(hit[here], new_left[here, None], none).min(axis=0))
            if (new_left == low[0]).all() and (new_right == low[1]).all():
                break
            low = [new_left, new_right]
        out = pd.concat([pd.DataFrame({"vec": ids[i], "links": links[i].astype(np.int64), "low": low[i]}) for i in (0, 1)])
        return out[out["links"] > 0]

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Two rows link when the cosine of their vectors, in double precision, is ``similarity`` or more. A vector that is
    null, empty, zero or has null or non-finite components links with nothing, and vectors of different lengths don't
    link. Equal vectors are compared once and counted as often as they occur. Ids are integers; rows that share an
    id and a vector count as two. A null id has no component and isn't kept. Extra columns are left out.

    The comparison of a cell is dealt out as pairs of blocks of about ``BLOCK`` vectors, those that live there against
    those looked up there, whatever the cell's size, and gives a row per vector and block pair, not per pair of vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    # Equal vectors first: a copied vector that holds a third of all rows is one row from here on.
    classes = rows.where("v IS NOT NULL AND id IS NOT NULL").groupBy("v").agg(F.min("id").alias("vec"), F.count("*").alias("n"))

    def usable(frames):
        for pdf in frames:
            yield pdf[unit_vectors(pdf["v"])[0]][["v", "vec", "n"]]

    kind = vectors.schema[vector_col].dataType.simpleString()
    classes = staged(classes.mapInPandas(usable, f"v {kind}, vec long, n long"), "vectors")
    cells = spark.sparkContext.broadcast(fit_cells(classes, classes.count()))
    placed = classes.mapInPandas(_assigned(cells, similarity), f"size int, home int, cells array<int>, vec long, n long, v {kind}")
    placed = staged(placed, "cells")
    looked = placed.select("size", F.explode("cells").alias("cell"), "home", "vec", "n", "v")
    # As many rows as cells.
    blocks = looked.groupBy("size", "cell").agg(
        F.ceil(F.count_if(F.col("home") == F.col("cell")) / BLOCK).cast("int").alias("left_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("right_blocks")
    )

    def dealt(rows: DataFrame, own: str, other: str, cells: Column) -> DataFrame:
        block = {own: F.pmod(F.xxhash64("vec"), F.col(f"{own}_blocks")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))}
        rows = rows.join(blocks.where("left_blocks > 0"), ["size", "cell"]).withColumns(block)
        return rows.select("size", "cell", "left", "right", "home", cells.alias("cells"), "vec", "n", "v")

    dealt_rows = dealt(placed.withColumn("cell", F.col("home")), "left", "right", F.col("cells")).union(
        dealt(looked, "right", "left", F.lit(None).cast("array<int>"))
    )
    found = staged(
        dealt_rows.groupBy("size", "cell", "left", "right").applyInPandas(_compared(similarity), "vec long, links long, low long"), "found"
    )
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    joined = components(found.where("vec != low").select("vec", "low")).select(F.col("node").alias("vec"), "component")
    known = classes.select("v", "vec", "n").join(counts, "vec", "left").join(joined, "vec", "left")
    known = staged(known.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id")), "known")
    out = rows.join(known, "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def keep_one_per_group(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """``vectors`` less all but the row with the smallest id of each group; rows without an id stay."""
    gone = link_vectors(vectors, id_col, vector_col, similarity).where(f"NOT kept AND `{id_col}` IS NOT NULL").select(id_col).distinct()
    return vectors.join(gone, id_col, "left_anti").select(*vectors.columns)
