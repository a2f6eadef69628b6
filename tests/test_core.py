"""The ordered, sweep and overlap primitives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querytide.functions.ordered import OrderedRows, with_row_number
from querytide.functions.quantiles import exact_percentiles
from querytide.operators import overlap as o


def runs(spark, rows):
    return spark.createDataFrame(
        rows, "query_id bigint, database_id int, start_us bigint, run_us bigint, query_idx int, engine string, error boolean"
    )


def random_runs(seed, n=300, span=400, longest=60):
    """A third of all rows in one database at one instant, zero-length runs, equal starts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        start = 100 if hot and i % 2 else rng.randrange(span)
        rows.append((i, 0 if hot else rng.randrange(4), start, rng.choice([0, 1, 5, rng.randrange(longest)]), i % 7, "e", i % 11 == 0))
    return rows


def brute(rows):
    """(earlier, later) pairs: an earlier run has not ended when the later one starts."""
    found = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and b[2] < a[2] + a[3]:
                found.add((a[0], b[0]))
    return found


def test_running_previous_and_row_number(spark, mode):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, t bigint, v bigint").repartition(5)
    ordered = OrderedRows(df, ["k"], ["t", "id"]).add_previous("t", "before")
    ordered.add_running({"total": F.col("v")}).add_row_number("n").add_running_max({"top": F.when(F.col("v") > 3, F.col("v"))})
    got = {r["id"]: r for r in ordered.rows().collect()}
    state = {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        before, total, n, top = state.get(k, (None, 0, 0, None))
        total, n = total + v, n + 1
        top = max(filter(lambda x: x is not None, (top, v if v > 3 else None)), default=None)
        assert (got[i]["before"], got[i]["total"], got[i]["n"], got[i]["top"]) == (before, total, n, top)
        state[k] = (t, total, n, top)


def test_chunked_rows_are_spread(spark, monkeypatch):
    """One key, in as many chunks as its size asks for, however many rows the sample has of it."""
    for chunk_rows, sample_rows in ((1000, 1 << 10), (100, 1 << 10), (50, 1 << 10), (1000, 500)):
        monkeypatch.setattr("querytide.functions.ordered.CHUNK_ROWS", chunk_rows)
        monkeypatch.setattr("querytide.functions.ordered.SAMPLE_ROWS", sample_rows)
        ordered = OrderedRows(spark.range(8000).withColumn("k", F.lit("one key")), ["k"], ["id"])
        sizes = [r["count"] for r in ordered.df.groupBy("_chunk").count().collect()]
        assert 0.8 * 8000 <= len(sizes) * chunk_rows <= 1.3 * 8000 and max(sizes) < 2.5 * chunk_rows
        got = ordered.add_running({"n": F.lit(1)}).rows()
        assert got.where("n != id + 1").count() == 0 and got.count() == 8000


def test_chunks_of_many_points(spark, monkeypatch):
    """Chunks follow the order for any number of split points, and a key counts as cut where it has rows in several chunks."""
    rng = np.random.default_rng(5)
    rows = [("a" if i < 900 else f"k{i % 200}", None if i % 9 == 0 else float("nan") if i % 7 == 0 else float(v), i) for i, v in enumerate(rng.integers(0, 50, 3000))]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    number = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    expected = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0], number(r[1]), r[2])))}
    for chunk_rows in (2000, 700, 40, 9):  # 1 to over 300 split points
        monkeypatch.setattr("querytide.functions.ordered.CHUNK_ROWS", chunk_rows)
        got = sorted(OrderedRows(df, ["k"], ["v", "id"]).df.collect(), key=lambda r: expected[r["id"]])
        chunks = [r["_chunk"] for r in got]
        assert chunks == sorted(chunks) and len(set(chunks)) >= 0.7 * 3000 / chunk_rows
        several = {k for k in {r["k"] for r in got} if len({r["_chunk"] for r in got if r["k"] == k}) > 1}
        assert several <= {r["k"] for r in got if r["_spans"]}
        assert len({r["k"] for r in got if r["_spans"]}) < len(set(chunks))


def test_sample_sends_few_rows(spark, monkeypatch):
    """All tasks together send little more than the sample, not as much each."""
    monkeypatch.setattr("querytide.functions.ordered.CHUNK_ROWS", 40)
    kind = type(spark.range(1))
    seen, limit = [], kind.limit
    monkeypatch.setattr(kind, "limit", lambda df, n: seen.append((n, df.count())) or limit(df, n))
    OrderedRows(spark.range(0, 40_000, 1, 16), [], ["id"])
    assert all(rows < 2 * n for n, rows in seen[1:]) and len(seen) > 1


def test_ordered_rows_take_one_shuffle(spark, monkeypatch):
    """Windows of one object run on the chunks as dealt; totals are summed before the shuffle and broadcast."""
    monkeypatch.setattr("querytide.functions.ordered.CHUNK_ROWS", 500)
    df = spark.range(8000).withColumn("k", F.col("id") % 3)
    rows = OrderedRows(df, ["k"], ["id"]).add_running({"a": F.col("id")}).add_previous("id", "b").rows()
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Window" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1


def test_row_number_without_keys(spark, mode):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "x int")
    assert {(r["x"], r["n"]) for r in with_row_number(df, [], ["x"], "n").collect()} == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)}


def test_percentiles(spark, mode):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 400), rng.integers(0, 90, 400))] + [(9, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for k in got:
        values = [v for kk, v in rows if kk == k]
        assert np.allclose([got[k]["p50"], got[k]["p95"], got[k]["p100"]], np.percentile(values, [50, 95, 100]))
    whole = exact_percentiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([v for _, v in rows]))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_overlap_against_brute_force(spark, mode, seed):
    rows = random_runs(seed)
    df, want = runs(spark, rows), brute(rows)
    pairs = {(r["earlier_query_id"], r["later_query_id"]) for r in o.ordered_pairs(df).collect()}
    assert pairs == want
    counts = {r["query_id"]: r["n_concurrent"] for r in o.concurrency_counts(df).collect()}
    assert counts == {r[0]: sum(r[0] in p for p in want) for r in rows}
    both = o.overlap_pairs(df).select("query_id", "other_query_id", "is_earlier").collect()
    assert len(both) == 2 * len(want)
    assert {(r["other_query_id"], r["query_id"]) for r in both if r["is_earlier"]} == want


def test_recent_and_weights_against_brute_force(spark, mode):
    rows = random_runs(5, n=200)
    df = runs(spark, rows)
    want = {
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[1] == b[1] and a[0] != b[0] and a[2] - 30 < b[2] + b[3] <= a[2] and (b[2], b[0]) < (a[2], a[0])
    }
    got = {(r["query_id"], r["other_query_id"]) for r in o.recently_finished(df, 30).collect()}
    assert got == want
    swept = o.neighbour_sweep(df, weights={"w": F.col("query_idx") + 0.25}, lookback_us=30).collect()
    value, overlaps = {r[0]: r[4] + 0.25 for r in rows}, brute(rows)
    for r in swept:
        i = r["query_id"]
        assert r["n_recent"] == sum(p[0] == i for p in want)
        assert float(r["w_before"]) == pytest.approx(sum(value[a] for a, b in overlaps if b == i))
        assert float(r["w_after"]) == pytest.approx(sum(value[b] for a, b in overlaps if a == i))
        assert float(r["w_recent"]) == pytest.approx(sum(value[b] for a, b in want if a == i))


@pytest.mark.parametrize("longest", [10, 400])
def test_neighbour_max_against_brute_force(spark, mode, longest):
    rows = random_runs(7, n=250, longest=longest)
    value, overlaps = {r[0]: float(r[0] * 37 % 101) for r in rows}, brute(rows)
    got = {r["query_id"]: r for r in o.neighbour_max(runs(spark, rows), F.col("query_id") * 37 % 101).collect()}
    for i in value:
        before = [value[a] for a, b in overlaps if b == i]
        after = [value[b] for a, b in overlaps if a == i]
        assert (got[i]["max_before"] if i in got else None) == (max(before) if before else None)
        assert (got[i]["max_after"] if i in got else None) == (max(after) if after else None)


def test_touching_runs_do_not_overlap(spark):
    rows = [(1, 0, 0, 10, 0, "e", False), (2, 0, 10, 5, 0, "e", False), (3, 0, 10, 0, 0, "e", False), (4, 1, 0, 99, 0, "e", False)]
    counts = {r["query_id"]: r["n_concurrent"] for r in o.concurrency_counts(runs(spark, rows)).collect()}
    assert counts == {1: 0, 2: 1, 3: 1, 4: 0}


def test_dataset_keeps_lonely_runs_and_their_columns(spark):
    rows = [(1, 0, 0, 10, 5, "a", False), (2, 0, 4, 10, 6, "b", False), (3, 0, 90, 1, 7, "a", False), (4, 0, 1, 50, 8, "a", True)]
    data = {r["query_id"]: r for r in o.concurrency_dataset(runs(spark, rows), lookback_us=100).collect()}
    assert set(data) == {1, 2, 3}
    assert [x["query_idx"] for x in data[2]["concur_info_train"]] == [5] and data[1]["num_concurrent_queries_train"] == 0
    assert data[3]["concur_info"] == [] and [x["query_id"] for x in data[3]["pre_exec_info"]] == [1, 2]
    alone = o.concurrency_dataset(runs(spark, rows), engine="a").collect()
    assert [r["num_concurrent_queries"] for r in alone] == [0, 0] and {r["query_idx"] for r in alone} == {5, 7}


@pytest.mark.parametrize("job", [o.overlap_pairs, o.concurrency_counts, lambda df: o.recently_finished(df, 30)])
def test_no_product_joins(spark, job):
    plan = job(runs(spark, random_runs(0, n=30)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
