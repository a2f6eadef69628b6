"""Edges of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from querytide.fixtures import view
from querytide.operators import contention as c
from querytide.operators import evaluate as ev
from querytide.operators import learn as m
from querytide.operators import profiles as p
from querytide.operators import shaping as s
from querytide.operators import stats as st
from querytide.plans import explain as e
from querytide.plans import sqltext as q
from querytide.sources import traces as t
from querytide.sources import workloads as w


def test_fill_binds(spark):
    rows = [("a :1 b :10 c :2", ["x", "y"] + [str(i) for i in range(3, 11)]), (":1 :2 :3", ["p", None, "r"]), ("none", [])]
    df = spark.createDataFrame(rows, "sql string, binds array<string>")
    got = [r[0] for r in df.select(s.fill_binds(F.col("sql"), F.col("binds"))).collect()]
    assert got == ["a x b 10 c y", ":1 :2 r", "none"]


def test_compress_and_stretch(spark, mode):
    df = spark.createDataFrame([(1, 500), (2, 510), (3, 2000), (4, 2010)], "query_id bigint, start_us bigint")
    got = {r["query_id"]: r["start_us"] for r in s.compress_idle(df, 400).collect()}
    assert got == {1: 400, 2: 410, 3: 810, 4: 820}
    one, two = s.stretch_gaps(df, 50, 10, seed=3).collect(), s.stretch_gaps(df.repartition(3), 50, 10, seed=3).collect()
    assert sorted(one) == sorted(two)
    starts = [r["start_us"] for r in sorted(one)]
    assert starts[0] == 500 and starts[1] > 510 and starts[2] - starts[1] == 1490


def test_nearest_runtime(spark, mode):
    bank = spark.createDataFrame([(7, 10), (8, 10), (9, 30)], "query_idx int, avg_us bigint")
    targets = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 99)], "query_id bigint, run_us bigint")
    got = {r["query_id"]: r["bank_query_idx"] for r in s.nearest_runtime(targets, bank).collect()}
    assert got == {1: 7, 2: 7, 3: 9, 4: 9}


def test_runtime_bucket_edges(spark):
    df = spark.createDataFrame([(x * s.MICROS,) for x in (5, 6, 30, 100, 101)], "r bigint")
    assert [r[0] for r in df.select(s.runtime_bucket(F.col("r"))).collect()] == [0, 1, 1, 3, 4]


def test_starvation_top_k(spark):
    rows = [(i, 0, 100, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id bigint, enter_us bigint, leave_us bigint, estimate double")
    got = p.starvation_top_k(df, 50, 1.0, 2).collect()
    assert {(r["snapshot_us"], r["place"], r["query_id"]) for r in got} == {(0, 1, 4), (0, 2, 3), (50, 1, 4), (50, 2, 3)}


def test_join_conditions(spark):
    texts = ["select 1 where b.x = a.y and a.y=b.x and s.i = s.j", 'on "t2"."c" = "t1"."d"', "nothing"]
    df = spark.createDataFrame([(x,) for x in texts], "sql string")
    found = [r[0] for r in df.select(q.canonical_conditions(q.join_conditions(F.col("sql")))).collect()]
    assert [tuple(x) for x in found[0]] == [("a", "y", "b", "x"), ("s", "j", "s", "i")]
    assert [tuple(x) for x in found[1]] == [("t1", "d", "t2", "c")] and found[2] == []


PLAN = """Gather  (cost=10.00..20.50 rows=7 width=8) (actual time=0.10..5.25 rows=6 loops=1)
  Workers Planned: 2
  ->  Hash Join  (cost=1.00..9.00 rows=70 width=16)
        ->  Index Scan using title_pkey on public.title t  (cost=0.10..2.00 rows=3 width=4)
        ->  Subquery Scan on sub  (cost=0.20..3.00 rows=4 width=4)
              ->  Seq Scan on "cast_info" ci  (cost=0.30..4.00 rows=5 width=4)"""


def test_plan_text(spark, mode):
    lines = [(1, i, line) for i, line in enumerate(PLAN.split("\n"))]
    df = spark.createDataFrame(lines, "query_idx int, line_no bigint, line string")
    nodes = e.plan_nodes(df)
    got = {r["node_pos"]: r for r in e.with_parents(nodes).collect()}
    assert [got[i]["op_name"] for i in range(5)] == ["Gather", "Hash Join", "Index Scan", "Subquery Scan", "Seq Scan"]
    assert [got[i]["parent_pos"] for i in range(5)] == [None, 0, 1, 1, 3]
    assert [got[i]["table_name"] for i in range(5)] == [None, None, "title", None, "cast_info"]
    assert got[2]["alias"] == "t" and got[4]["alias"] == "ci" and got[0]["workers_planned"] == 2
    assert (got[0]["act_time"], got[0]["act_card"], got[1]["act_time"]) == (5.25, 6.0, None)


def test_flattened_plans(spark, tmp_path):
    text = """{"database_stats": {"column_stats": [{"tablename": "t", "attname": "a"}], "table_stats": [{"relname": "t"}]},
      "parsed_plans": [{"plan_parameters": {"op_name": "A", "est_card": 1.0}, "children": [
        {"plan_parameters": {"op_name": "B"}, "children": [{"plan_parameters": {"op_name": "C"}, "children": []}]},
        {"plan_parameters": {"op_name": "D", "table": 3}, "children": []}]},
      {"plan_parameters": {"op_name": "E"}, "children": []}]}"""
    (tmp_path / "plans.json").write_text(text)
    nodes, columns, tables = w.read_parsed_plans(spark, str(tmp_path / "plans.json"))
    got = sorted((r["query_idx"], r["node_pos"], r["op_name"], r["parent_pos"], r["depth"]) for r in nodes.collect())
    assert got == [(0, 0, "A", None, 0), (0, 1, "B", 0, 1), (0, 2, "C", 1, 2), (0, 3, "D", 0, 1), (1, 0, "E", None, 0)]
    assert columns.first()["attname"] == "a" and tables.first()["relname"] == "t"


def test_client_files(spark, tmp_path):
    header = "timestamp,time_since_execution_s,time_of_day,query_idx,run_time_s,engine\n"
    for name, idx in [("trace_client_0", 1), ("repeating_olap_batch_0", 2), ("repeating_olap_batch_1", 3), ("trace_client_0_2", 4),
                      ("trace_client_1_5", 5), ("trace_client_12", 6), ("other", 7), ("trace_client_0_25", 8)]:
        (tmp_path / f"{name}.csv").write_text(header + f"2024-01-01 00:00:00,1.5,00:01,{idx},2.5,postgres\n")
    ids = lambda df: sorted(r["query_idx"] for r in df.collect())
    assert ids(t.read_client_traces(spark, str(tmp_path))) == [1, 3, 6]
    assert ids(t.read_client_traces(spark, str(tmp_path), clients=10)) == [1, 3]
    assert ids(t.read_client_traces(spark, str(tmp_path), version=5)) == [5]
    assert ids(t.read_client_traces(spark, str(tmp_path), all_versions=True)) == [1, 3, 4, 6, 8]


def test_bank_and_templates(spark, tmp_path):
    (tmp_path / "bank.sql").write_text("select 1;\n  select\n 2 ;\ntail without end")
    bank = w.read_query_bank(spark, str(tmp_path / "bank.sql")).orderBy("query_idx").collect()
    assert [(r["query_idx"], r["sql"]) for r in bank] == [(0, "select 1;"), (1, "select\n 2;")]
    folder = tmp_path / "templates"
    folder.mkdir()
    (folder / "12.sql").write_text("\nselect :1\n")
    assert [tuple(r) for r in w.read_sql_templates(spark, str(folder)).collect()] == [(12, "select :1")]


def test_cab_document(spark, tmp_path):
    (tmp_path / "cab.json").write_text(
        '{"scale_factor": 7, "queries": [{"query_id": 99, "start": 500, "arguments": [1]},'
        ' {"query_id": 3, "start": 2500, "arguments": [2, 1.5, "x", null]}]}'
    )
    templates = spark.createDataFrame([(3,)], "template_id int")
    row = w.read_cab_trace(spark, str(tmp_path / "cab.json"), templates).first()
    assert (row["start_s"], row["g_offset_since_start_s"], row["arguments"]) == (2.5, 2.0, ["2", "1.5", "x", None])


def test_merged_statistics_equal_all_at_once(spark):
    rows = [(i, 1, i * 10, (i * 7919) % 1000) for i in range(50)]
    df = spark.createDataFrame(rows, "query_id bigint, query_idx int, start_us bigint, run_us bigint")
    parts = st.merge_moments(st.runtime_moments(df.where("query_id < 20")), st.runtime_moments(df.where("query_id >= 20")))
    got = st.moments_to_statistics(parts).first()
    values = [r[3] for r in rows]
    assert got["mean_us"] == pytest.approx(np.mean(values)) and got["std_us"] == pytest.approx(np.std(values))
    assert got["latest_us"] == values[-1] and got["n"] == 50


def test_queueing_curve_recovers_its_parameters(spark):
    rows = []
    for i in range(200):
        n, iso = i % 30, 10.0
        rows.append((i, 1, n, n, int(1e6 * (4 * max(n - 8, 0) + (1 + 0.2 * min(n, 8)) * iso))))
    counted = spark.createDataFrame(rows, "query_id bigint, query_idx int, n_prior bigint, n_all bigint, run_us bigint")
    isolated = spark.createDataFrame([(1, 1e7)], "query_idx int, isolated_us double")
    fit = st.fit_queueing_curve(counted, isolated).first()
    assert fit["b1"] == 8 and fit["a1"] == pytest.approx(4) and fit["a2"] == pytest.approx(0.2)
    scored = st.predict_queueing_curve(counted, isolated, st.fit_queueing_curve(counted, isolated))
    assert scored.agg(F.max(F.abs(F.col("prediction_s") - F.col("label_s")))).first()[0] < 1e-6


def test_mix_regression_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    mixes = rng.integers(0, 6, (120, 3))
    y = 2.0 + mixes @ np.array([1.0, 0.5, 3.0]) + rng.normal(0, 0.1, 120)
    rows = [(i, 0, i % 2, int(1e6 * y[i]), [int(v) for v in mixes[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "query_id bigint, query_idx int, cluster int, run_us bigint, mix array<bigint>")
    fits = {r["cluster"]: r for r in m.fit_mix_regression(df, 3).collect()}
    for k in (0, 1):
        pick = [i for i in range(120) if i % 2 == k]
        want = np.linalg.lstsq(np.column_stack([np.ones(len(pick)), mixes[pick]]), y[pick], rcond=None)[0]
        assert np.allclose([fits[k]["intercept"], *fits[k]["coefficients"]], want, atol=1e-4)
    error = m.predict_mix(df, m.fit_mix_regression(df, 3)).agg(F.avg(F.abs(F.col("prediction_s") - F.col("label_s")))).first()[0]
    assert error < 0.2


def test_boosted_trees_beat_the_mean(spark):
    df = spark.range(400).select(
        F.col("id").alias("query_id"), F.array((F.col("id") % 10).cast("double"), F.lit(1.0)).alias("features"),
        (F.col("id") % 10 * 3.0).alias("label_s"),
    )
    model = m.fit_gbt(df, "features", "label_s", rounds=20, depth=4)
    scored = m.predict_gbt(model, df, "features", 0.01)
    row = scored.agg(F.avg(F.abs(F.col("prediction_s") - F.col("label_s"))), F.min("prediction_s")).first()
    assert row[0] < 4 and row[1] >= 0.01


def test_kmeans_small_case(spark):
    df = spark.createDataFrame([(9, [1.0]), (4, [2.0])], "query_idx int, features array<double>")
    assert {(r["query_idx"], r["cluster"]) for r in m.cluster_each(df).collect()} == {(4, 0), (9, 1)}


def test_score_without_neighbours_is_io_plus_cpu(spark):
    values = dict(zip(c.CONTENTION_COLUMNS, (10.0, 12.0, 0.0, 0.0, 100.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0)))
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    io = 2 * 100.0 / (20 + 200)
    load = max(math.log(0.0001) * math.log(0.5 * 2 + 0.5 * 1 + 0.0001), 0)
    assert df.select(c.contention_score()).first()[0] == pytest.approx(io + (1 + 0.1 * load) * (0.8 * 10 + 0.2 * 12 - io))


def test_q_loss(spark):
    df = spark.createDataFrame([(-1.0, 3.0), (2.0, 4.0), (10.0, 20.0)], "p double, l double")
    got = [r[0] for r in df.select(ev.q_loss(F.col("p"), F.col("l"))).collect()]
    assert got == pytest.approx([2e5, 0.2, math.log(2)])


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0, 50, 100, 100, 999)], "run_us bigint")
    got = {r["bin"]: r["n"] for r in p.runtime_histogram(df, 200, 4).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2}


def test_block_sample(spark, mode):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = sorted(r["k"] for r in t.block_sample(df, ["k"], 5, 0.1).collect())
    assert got == [0, 1, 2, 3, 4, 50, 51, 52, 53, 54]


def test_ratios_with_zeros(spark):
    from querytide.operators.evaluate import q_error

    rows = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)], "p double, l double")
    assert [r[0] for r in rows.select(q_error(F.col("p"), F.col("l"))).collect()] == [2.0, float("inf"), float("inf"), 1.0]


def test_every_supplier_is_a_table(spark, tmp_path):
    for name, rows, columns in (
        ("supplier", [(i,) for i in range(40)], "s_suppkey long"),
        ("part", [(i, "ECONOMY", 3, 9.5) for i in range(80)], "p_partkey long, p_type string, p_size int, p_retailprice double"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert view(spark, str(tmp_path), "table_stats").count() == 40
    assert view(spark, str(tmp_path), "column_stats").count() == 160
    assert view(spark, str(tmp_path), "plan_nodes").select("table_name").distinct().count() == 40


@pytest.mark.parametrize(("prior_only", "lookback_us"), [(False, None), (True, 20), (False, 20)])
def test_data_sharing_unfolds_to_classes_of_tables(spark, monkeypatch, prior_only, lookback_us):
    runs = [(i, i % 2, (0, 1, 0, 2, 1, 0, 2, 1)[i], 7 * i, 35) for i in range(8)] + [(8, 0, 0, 60, 5), (9, 1, 2, 500, 10), (10, 0, 7, 1, 90)]
    # Forty tables of one query, three of two queries, and one of two queries.
    scans = [(0, f"a{i}", 1.0 + i) for i in range(40)] + [(q, f"b{i}", 2.0 + q + i) for q in (0, 1) for i in range(3)] + [(1, "c", 3.0), (2, "c", 5.0)]
    sizes = {t: 8.0 * (i % 5) for i, t in enumerate(dict.fromkeys(t for _, t, _ in scans))}
    scanned = {(q, t): mb for q, t, mb in scans}
    want = {}
    for i, db, q, start, run in runs:
        near = [r for r in runs if r[1] == db and r[0] != i and (r[3], r[0]) < (start, i) and r[3] + r[4] > start]
        if not prior_only:
            near += [r for r in runs if r[1] == db and (start, i) < (r[3], r[0]) and r[3] < start + run]
        if lookback_us is not None:
            near += [r for r in runs if r[1] == db and r[0] != i and start - lookback_us < r[3] + r[4] <= start]
        own = {t: mb for (p, t), mb in scanned.items() if p == q}
        share = {t: sum(round(scanned[r[2], t] / sizes[t], 12) for r in near if (r[2], t) in scanned and sizes[t]) for t in own}
        if own:
            want[i] = min(sum(min(share[t] * mb, mb) for t, mb in own.items()) / sum(own.values()), 1.0)
    swept = []

    def counting(rows, *args, **kwargs):
        swept.append(rows.count())
        return neighbour_sweep(rows, *args, **kwargs)

    neighbour_sweep = c.neighbour_sweep
    monkeypatch.setattr(c, "neighbour_sweep", counting)
    found = c.data_sharing(
        spark.createDataFrame(runs, "query_id bigint, database_id bigint, query_idx int, start_us bigint, run_us bigint"),
        spark.createDataFrame(scans, "query_idx int, table_name string, scan_mb double"),
        spark.createDataFrame([*sizes.items()], "relname string, size_mb double"),
        prior_only=prior_only, lookback_us=lookback_us,
    )
    assert {r["query_id"]: r["sharing"] for r in found.collect()} == pytest.approx(want)
    assert len(set(want.values())) > 3
    # Per run at most one row of the first class, two of the second, one of the third; not one of each table.
    assert sum(swept) <= 3 * len(runs)
