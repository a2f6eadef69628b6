"""Vector codes and top-k search against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querytide.llm import topk_search, vector_codes
from querytide.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, v string, size int, codes string, q long"


def vectors(n=230, width=16, seed=4):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    data = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(base)], rng.choice([1, 2, None])) for i in range(n)]
    data += [(1000 + i, data[50][1], 2) for i in range(70)]  # a vector with a quarter of the rows
    data += [(2000, None, 1), (2001, [0.1] * 15 + [float("nan")], 1), (2002, [float("inf")] * width, 1), (2003, [None] * width, None), (2004, [], 1)]
    data += [(2050, [0.0] * width, None), (-50, [-0.25] * width, 7)]
    return data


@pytest.fixture(scope="module")
def table(spark):
    def make(data):
        return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in data], SCHEMA).repartition(4)
    return make


def usable(data):
    return [(i, v, label) for i, v, label in data if v and all(x is not None and math.isfinite(x) for x in v)]


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def codes_by_hand(data, parts=8, entries=16, rounds=6):
    rows = [(i, whole(v, 4096), label) for i, v, label in usable(data)]
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(rows, key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in rows:
            for p in range(parts):
                members[p, near(cut(v, p), books[p])[1]].append(cut(v, p))
        for (p, k), own in members.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], defaultdict(int)
    for i, v, label in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, [k for _, k in found], sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted((i, c, e, by_label[label]) for i, c, e, label in out), books


def coded(df, **more):
    rows, books = vector_codes.compress(df, **more)
    return sorted((r.vec_id, r.codes, r.error, r.label_error) for r in rows.collect()), books


def test_codes_equal_brute_force(table):
    data = vectors()
    got, books = coded(table(data))
    want, by_hand = codes_by_hand(data)
    assert got == want and books.entries.tolist() == by_hand
    far = [(i, [x * 100 for x in v], label) for i, v, label in usable(data)]  # sums far apart, so searches end early
    assert coded(table(far))[0] == codes_by_hand(far)[0]


def test_codes_edges(spark, table, monkeypatch):
    assert coded(table([])) == ([], None)
    few = [(3, [0.5] * 8, None), (3, [0.5] * 8, None), (1, [-0.5] * 8, 4), (9, [0.1] * 16, 4), (8, [0.1] * 9, 4)]
    got, books = coded(table(few))
    assert got == codes_by_hand(few[:3])[0] and books.entries.shape == (8, 3, 1)  # another length is left out, a repeated row counts twice
    rows, books = vector_codes.compress(table(few[:3] + [(None, [0.25] * 8, 1)]))
    assert books.entries[0].ravel().tolist() == [-2048, 2048, 2048, 1024]  # a null id comes last
    assert [r.codes for r in rows.where("vec_id IS NULL").collect()] == [[3] * 8]
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 2)  # labels with fewer than half of the rows take the other join
    data = vectors()
    assert coded(table(data))[0] == codes_by_hand(data)[0]
    assert len(coded(table(data).drop("label"), label_col=None)[0]) == len(usable(data))
    with pytest.raises(Exception, match="too large"):
        coded(table([(1, [1e30] * 8, 1)]))


def test_codes_stand_for_near_vectors(table):
    rows, books = vector_codes.compress(table(vectors()))
    back = rows.select("vec_id", vector_codes.restored(F.col("codes"), books).alias("back"))
    given = {i: v for i, v, _ in usable(vectors())}
    for r in back.collect():
        assert len(r.back) == 16 and math.dist(r.back, given[r.vec_id]) < 1


def test_search_finds_the_nearest_entry():
    rng = np.random.default_rng(1)
    for width in (1, 3, 8):
        for spread in (2, 3000):
            x, book = rng.integers(-spread, spread, (400, width)), rng.integers(-spread, spread, (17, width))
            gaps = ((x[:, None] - book) ** 2).sum(axis=2)
            at, best = vector_codes.nearest(x, book)
            assert (at == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


def top_by_hand(data, k=5, every=50):
    rows = [(i, whole(v, 256)) for i, v, _ in usable(data)]
    out = []
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q and len(x) == len(y))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def top(df, **more):
    return sorted(tuple(r) for r in topk_search.top_k(df.where("vec_id % 50 = 0"), df, **more).collect())


def test_top_k_equals_brute_force(table, monkeypatch):
    data = vectors()
    assert top(table(data)) == top_by_hand(data)
    for name, value in (("QUERY_BLOCK", 3), ("CANDIDATE_BLOCK", 40), ("TILE", 2)):
        monkeypatch.setattr(topk_search, name, value)
    for slices in (1, 2, 3, 16):
        assert top(table(data), slices=slices) == top_by_hand(data)


def test_top_k_edges(table):
    assert top(table([])) == []
    one = [(50, [0.5] * 4, 1)]
    assert top(table(one)) == []
    data = [(50, [0.5] * 4, 1), (100, [0.5] * 4, 1), (7, [0.5] * 4, None), (7, [0.5] * 4, None), (None, [9.0] * 4, 1), (8, [1.0] * 5, 1), (150, [2.0], 1), (51, [-3.0], 1)]
    want = top_by_hand([r for r in data[:3] + data[5:]])
    assert top(table(data)) == want  # a repeated row counts once, a row without id takes no part
    ties = [(i, [1.0, 0.0], 1) for i in range(0, 400, 10)]
    assert top(table(ties), k=3) == top_by_hand(ties, k=3)


def test_queries_have_the_columns_asked_for(spark, tmp_path, table):
    table(vectors()).write.parquet(f"{tmp_path}/embeddings.parquet")
    codes, best = (QUERIES[n](spark, str(tmp_path)) for n in ("op11_vector_codes", "op13_topk_search"))
    assert codes.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert best.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert all(len(r.code) == 16 for r in codes.collect())
