"""Runs in flight and statistics on streams, deficits, conflict ranges, large documents: hand-made and random rows against brute force."""

import datetime
import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from querytide.functions.ordered import with_row_number
from querytide.functions.sweep import block_size, later_deficits, unfold_ranges
from querytide.operators import graphs as g
from querytide.operators import learn
from querytide.operators import overlap as o
from querytide.plans import features
from querytide.registry import load
from querytide.registry.learn import _node_tables, _placed
from querytide.sources import workloads as w
from querytide.sources.documents import read_json_parts, read_records
from querytide.streaming import jobs as j

MINUTE = 60_000_000


def runs(n=60, seed=5):
    """(query_id, database_id, start_us, run_us), some of hours, some of no length, several at one moment."""
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 2]), rng.randrange(0, 240) * MINUTE, rng.choice([0, 0, 1, MINUTE, 7 * MINUTE, 200 * MINUTE])) for i in range(n)]


def in_flight_by_hand(rows):
    out = []
    for i, d, s, _ in rows:
        out.append((d, i, sum(1 for k, e, t, r in rows if e == d and (t, k) < (s, i) and t + r > s)))
    return sorted(out)


def streamed(spark, batches, schema, path, build):
    """The result of ``build`` over rows that arrive batch by batch."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    own = j.streaming_session(spark, 2)
    stream = own.readStream.schema(own.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return build(stream)


def test_in_flight_with_runs_longer_than_the_lateness(spark, tmp_path):
    """Finishes arrive when they happen, hours after their starts; records within the lateness may come in any order."""
    data = runs()
    schema = "query_id long, database_id int, start_us long, run_us long"
    records = j.start_and_finish(spark.createDataFrame(data, schema)).collect()
    records.sort(key=lambda r: r.at)
    cut = [records[k : k + 25] for k in range(0, len(records), 25)]
    random.Random(1).shuffle(cut[0])
    kind = j.start_and_finish(spark.createDataFrame([], schema)).schema
    far = [(-1, -1, 0, (1, -1, -1), 1, records[-1].at + timedelta(days=2))]
    build = lambda s: j.run_available(j.in_flight(s, lateness="2 hours"), f"{tmp_path}/out")
    found = streamed(spark, [*[[tuple(r) for r in c] for c in cut], far], kind, str(tmp_path), build)
    assert sorted(tuple(r) for r in found.where("database_id >= 0").collect()) == in_flight_by_hand(data)


def test_statistics_expire_and_a_batch_can_be_run_again(spark, tmp_path):
    schema = "query_idx int, query_id long, start_us long, run_us long"
    day = 24 * 60 * MINUTE
    batches = [[(1, 1, 0, 10), (1, 2, 5, 30), (2, 3, 1, 10**13)], [(1, 4, day, 20)], [(3, 5, 40 * day, 1)], [(3, 6, 41 * day, 3)], [(1, 7, 42 * day, 50), (2, 8, 42 * day, 6)]]
    build = lambda s: j.run_available(j.runtime_statistics(s, timedelta(days=10), "1 day"), f"{tmp_path}/out", "query_idx")
    got = {r.query_idx: r for r in streamed(spark, batches, schema, str(tmp_path), build).collect()}
    assert (got[1].n, got[1].mean_us, got[1].latest_us) == (1, 50.0, 50)  # forgotten after ten days, then new
    assert (got[2].n, got[2].mean_us) == (1, 6.0)
    assert (got[3].n, got[3].mean_us, got[3].std_us, got[3].latest_us) == (2, 2.0, 1.0, 3)
    write = j.latest_per_key(f"{tmp_path}/sink", "k")
    one, two = (spark.createDataFrame(rows, "k int, v int") for rows in ([(1, 1), (2, 1)], [(2, 2), (3, 2)]))
    for batch, number in ((one, 0), (two, 1), (two, 1), (one.where("k = 1"), 2), (one.where("k = 1"), 2)):
        write(batch, number)
    assert sorted(map(tuple, j.read_latest(spark, f"{tmp_path}/sink", one.schema).collect())) == [(1, 1), (2, 2), (3, 2)]
    assert sorted(p.name for p in (tmp_path / "sink").iterdir()) == ["batch=1", "batch=2"]


def test_deficits_equal_brute_force(spark, mode):
    rng = random.Random(3)
    rows, want = [], {}
    for key in (1, 2):
        spans = sorted((rng.randrange(900), rng.choice([1, 5, 40, 700])) for _ in range(90))
        for rank, (s, n) in enumerate(spans, 1):
            reach = sum(1 for t, _ in spans[rank:] if t < s + n)
            rows.append((key, key * 1000 + rank, rank, reach, s + n))
        for rank, (s, n) in enumerate(spans, 1):
            want[key * 1000 + rank] = sum(max(0, s + n - t - m) for t, m in spans[rank:] if t < s + n)
    df = spark.createDataFrame(rows, "k int, id long, rank long, reach long, e long")
    got = {r.id: int(r.deficit) for r in later_deficits(df, ["k"], "id", "rank", "reach", "e").collect()}
    assert {i: got.get(i, 0) for i in want} == want
    assert later_deficits(df.limit(0), ["k"], "id", "rank", "reach", "e").count() == 0


def test_conflict_ranges_hold_the_edges(spark, mode):
    """Degrees, overlaps and expanded edges of random nodes, some without length, against all pairs."""
    rng = random.Random(6)
    nodes = []
    for i in range(70):
        s, n = rng.randrange(60), rng.choice([0, 3, 3, 9, 40])
        nodes.append((1 + i % 2, i, i, 0, s, 0.0, float(n) / 1000 * 1000, "ab"[i % 3 % 2]))
    placed = spark.createDataFrame([(a, b, c, d, e, f, h) for a, b, c, d, e, f, h, _ in nodes], "window_id int, oid long, query_idx int, node_pos int, start_us long, est_startup_cost double, est_cost double")
    tables = spark.createDataFrame([(n[2], 0, n[7]) for n in nodes], "query_idx int, node_pos int, table_name string")
    ranges = g.conflict_ranges(placed, tables)
    edges, first, later = {}, {}, {}
    for a in nodes:
        for b in nodes:
            (s, e), (t, f) = (a[4], a[4] + a[6]), (b[4], b[4] + b[6])
            if a[0] == b[0] and a[7] == b[7] and e < f and t < e:
                first.setdefault(b[1], []).append(e - t)
                later.setdefault(a[1], []).append(e - t)
                weight = -0.1 * 2 * (e - t) / (f - min(s, t))
                edges |= {(a[1], b[1]): weight, (b[1], a[1]): weight}
    for r in ranges.collect():
        got = (r.n_first, r.overlap_first_us, r.n_later, r.overlap_later_us)
        assert got == (len(first.get(r.oid, [])), sum(first.get(r.oid, [])), len(later.get(r.oid, [])), sum(later.get(r.oid, []))), r
    found = {(r.source, r.target): r.weight for r in g.expand_conflicts(ranges, [2.0]).collect()}
    assert found.keys() == edges.keys() and all(abs(found[k] - edges[k]) < 1e-12 for k in edges)
    some = g.expand_conflicts(ranges, [2.0], placed.where("oid = 8"))
    end = lambda oid: nodes[oid][4] + nodes[oid][6]
    assert {(r.source, r.target) for r in some.collect()} == {k for k in edges if 8 in k and max(k, key=end) == 8}


@pytest.fixture
def small_ranges(spark):
    """Files are cut into many small ranges of bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_statements_of_one_file_from_many_tasks(spark, tmp_path, small_ranges):
    statements = [f"select {'x' * (k % 37)}\n from t{k}" for k in range(80)] + ["", "  "]
    for name, tail in (("a", ""), ("b", "\n"), ("c", " not ended")):
        (tmp_path / name).write_text("; ".join(statements) + ";" + tail)
    rows = w.read_query_bank(spark, str(tmp_path))
    assert read_records(spark, str(tmp_path / "a"), ";").count() == len(statements)
    for name in "abc":
        got = [tuple(r) for r in rows.where(F.col("file").endswith(f"/{name}")).orderBy("query_idx").select("query_idx", "sql").collect()]
        assert got == [(k, s.strip() + ";") for k, s in enumerate(statements)]


def nested(depth, k):
    node = {"plain_content": [], "plan_parameters": {"op_name": f'Scan "{{{k}}}" }}', "table": k, "est_card": depth}}
    if depth:
        node["children"] = [nested(depth - 1, k), {"plan_parameters": {"op_name": "Hash"}, "children": []}]
    return node


def test_parsed_plans_of_any_depth(spark, tmp_path, small_ranges, monkeypatch):
    """Braces and quotes in strings, plans that are null, statistics before or after the plans, any white space."""
    monkeypatch.setattr("querytide.functions.ordered.CHUNK_ROWS", 20)
    plans = [nested(k * 2, k) | {"plan_runtime": k / 2, "tables": ["a"], "num_tables": 1} for k in range(14)]
    plans[7] = plans[8] = plans[0] = None
    stats = {"column_stats": [{"tablename": "a", "attname": 'x"}', "avg_width": 4, "data_type": "int"}], "table_stats": [{"relname": "a", "reltuples": 9}]}
    documents = {"p": {"database_stats": stats, "parsed_plans": plans}, "q": {"parsed_plans": plans, "database_stats": stats}}
    for indent in (None, 2):
        for name, document in list(documents.items())[: 2 if indent else 1]:
            path = tmp_path / f"{name}{indent}.json"
            path.write_text(json.dumps(document, indent=indent) + "\n")
            nodes, columns, tables = w.read_parsed_plans(spark, str(path))
            want = []
            for k, plan in enumerate(plans):
                waiting, n = [(plan, None, 0)] if plan else [], 0
                while waiting:
                    node, parent, depth = waiting.pop()
                    p = node["plan_parameters"]
                    want.append((k, n, parent, depth, p["op_name"], str(p["table"]) if "table" in p else None, node.get("plan_runtime")))
                    waiting += [(c, n, depth + 1) for c in reversed(node.get("children", []))]
                    n += 1
            got = nodes.select("query_idx", "node_pos", "parent_pos", "depth", "op_name", "table_name", "plan_runtime")
            assert sorted(tuple(r) for r in got.orderBy("query_idx", "node_pos").collect()) == sorted(want, key=lambda t: t[:2])
            assert [(r.column_id, r.attname, r.avg_width, r.data_type) for r in columns.collect()] == [(0, 'x"}', 4.0, "int")]
            assert [(r.table_id, r.relname, r.reltuples) for r in tables.collect()] == [(0, "a", 9.0)]


def test_trace_documents(spark, tmp_path, small_ranges):
    queries = [{"query_id": k % 3, "start": 1000.0 * k + 500, "arguments": [k, 'a "}{" b', None, 2.5]} for k in range(30)]
    (tmp_path / "a.json").write_text(json.dumps({"scale_factor": 7, "queries": queries}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"queries": queries[5:9], "scale_factor": 8}))
    (tmp_path / "c.json").write_text(json.dumps({"scale_factor": 9, "queries": []}))
    rows = w.read_cab_trace(spark, str(tmp_path))
    got = sorted((r.scale_factor, r.position, r.template_id, r.start_s, r.g_offset_since_start_s, r.arguments) for r in rows.collect())
    want = [(7, k, k % 3, k + 0.5, float(k), [str(k), 'a "}{" b', None, "2.5"]) for k in range(30)]
    want += [(8, k, (k + 5) % 3, k + 5.5, float(k), [str(k + 5), 'a "}{" b', None, "2.5"]) for k in range(4)]
    assert got == want
    assert {r.key for r in read_json_parts(spark, str(tmp_path / "c.json")).collect()} == {"scale_factor", "queries"}


def test_models_of_few_rows(spark):
    """Nothing to learn from gives no predictions; rows that are all or none held out are all learned from."""
    rows = spark.createDataFrame([(i, [float(i % 3)], float(i)) for i in range(20)], "query_id long, features array<double>, label_s double")
    empty = rows.where("query_id < 0")
    got = learn.predict_gbt(learn.fit_gbt(empty, "features", "label_s", rounds=2, depth=2), empty, "features", 0.01)
    assert got.columns == ["query_id", "features", "label_s", "prediction_s"] and got.count() == 0
    held = F.pmod(F.xxhash64("query_id", F.lit(0)), F.lit(5)) == 0
    for some in (rows.where(held), rows.where(~held)):
        predicted = learn.predict_gbt(learn.fit_gbt(some, "features", "label_s", rounds=2, depth=2), some, "features", 0.01)
        assert predicted.where("prediction_s > 0").count() == some.count() > 0


def test_conflict_query_lists_every_edge(spark, tmp_path):
    """``graph_conflict_edges`` gives each edge both ways, not only their number."""
    start = datetime.datetime(2024, 1, 1)
    events = [(i, i % 2, "view", start + datetime.timedelta(hours=40 if i == 9 else 0), 30.0 + i, '{"k": 1}') for i in range(10)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    parts = [(101 + 100 * i, "ECONOMY", 3 + i, 10.0 * i) for i in range(4)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i,) for i in range(5)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = load()[0]["graph_conflict_edges"](spark, str(tmp_path))
    edges = {(r.window_id, r.table_name, r.source, r.target): r.weight for r in got.collect()}
    ranges = g.conflict_ranges(_placed(spark, str(tmp_path)), _node_tables(spark, str(tmp_path)))
    assert len(edges) == 2 * sum(r.n_first for r in ranges.collect()) > 0
    assert all(edges[(w, t, b, a)] == weight < 0 for (w, t, a, b), weight in edges.items())


def test_plan_document_without_broadcast(spark, tmp_path, monkeypatch):
    """The document's texts go from task to task, not through the driver."""
    from pyspark.sql import DataFrameWriter

    from querytide.registry import sources

    part = "id AS p_partkey, 'SMALL' AS p_type, CAST(id % 9 AS INT) AS p_size, CAST(id AS DOUBLE) AS p_retailprice"
    spark.range(900).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 4).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    plans, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda w, *a, **k: plans.append(w._df._jdf.queryExecution().executedPlan().toString()) or text(w, *a, **k))
    nodes, columns, tables = w.read_parsed_plans(spark, sources._document(spark, str(tmp_path)))
    # Only the four column names of the catalogue view are broadcast.
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0] and plans[0].count("BroadcastNestedLoopJoin") <= 1
    assert (columns.count(), tables.count()) == (12, 3)


def test_profile_reads_in_many_tasks(spark, monkeypatch):
    """Columns are unfolded and ordered by more tasks than the table has files."""
    seen = []
    monkeypatch.setattr(features, "with_row_number", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or with_row_number(df, *a))
    table = spark.range(0, 300_000, 1, 1).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    got = {r["attname"]: r for r in features.profile_columns(table, "id").collect()}
    assert seen[0] > 1 and got["text"]["n_distinct"] == 300_000 and round(got["id"]["correlation"], 9) == 1


@pytest.mark.parametrize("length", [1, 100, 20_000])
def test_ranges_unfold_to_a_few_blocks_however_long(spark, length):
    """With blocks of 64 the longest ranges here unfolded to 313 rows each."""
    rows = 1 << 17
    ranges = spark.range(rows).select(F.col("id").alias("low"), (F.col("id") + length - 1).alias("high"))
    block = block_size(ranges, "low", "high")
    assert block == max(64, min(length // 4, rows // 512))
    assert unfold_ranges(ranges, "low", "high", block).count() <= (length / block + 2) * rows


TRACE = "query_id bigint, database_id int, start_us bigint, run_us bigint, query_idx int, engine string, error boolean"


def lists_by_hand(rows, back):
    """Per id: earlier, later and recent ids by start."""
    out = {}
    by_start = sorted(set(rows), key=lambda r: (r[2], r[0]))
    for i, d, s, r, *_ in by_start:
        same = [x for x in by_start if x[1] == d and x[0] != i]
        out[i] = (
            [x[0] for x in same if (x[2], x[0]) < (s, i) and x[2] + x[3] > s],
            [x[0] for x in same if (x[2], x[0]) > (s, i) and x[2] < s + r],
            [x[0] for x in same if s - back < x[2] + x[3] <= s],
        )
    return out


def busy_trace(n=260, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice([0, 0, 1]), rng.randrange(500) * 10 + i % 10, rng.choice([1, 9, 300, 3000]), i % 5, "e", False) for i in range(n)]


@pytest.mark.parametrize("again", [(), (3, 77, 200)])
def test_neighbour_lists_without_shuffled_pairs(spark, mode, monkeypatch, again):
    """Several blocks, ids that repeat, and a run without database: its lists are empty."""
    monkeypatch.setattr("querytide.functions.sweep.LEAST_BLOCKS", 2)
    rows = busy_trace()
    want = lists_by_hand(rows, 50)
    trace = spark.createDataFrame([*rows, *[rows[k] for k in again], (999, None, 5, 700, 1, "e", False)], TRACE)
    got = o.concurrency_dataset(trace, lookback_us=50).collect()
    assert len(got) == len(rows) + len(again) + 1
    ids = lambda found: [x["query_id"] for x in found]
    for r in got:
        earlier, later, recent = want.get(r["query_id"], ([], [], []))
        assert sorted(ids(r["concur_info_train"])) == sorted(earlier) and sorted(ids(r["concur_info"])) == sorted(earlier + later), r["query_id"]
        assert all(list(r[c]) == sorted(r[c]) for c in ("concur_info", "concur_info_train", "pre_exec_info"))
        assert sorted(ids(r["pre_exec_info"])) == sorted(recent) and r["num_concurrent_queries"] == len(earlier + later)


def test_dataset_moves_no_pairs(spark):
    """All 400 runs overlap: 159,600 neighbours, formerly each a shuffled row of its own before lists were collected."""
    trace = spark.createDataFrame([(i, 0, i, 10_000, i % 5, "e", False) for i in range(400)], TRACE)
    plan = o.concurrency_dataset(trace)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(start_us" not in plan and plan.count("Join Inner") <= 1, plan
    assert {r["num_concurrent_queries"] for r in o.concurrency_dataset(trace).collect()} == {399}


@pytest.mark.parametrize("again", [(), (3, 77)])
def test_sequences_against_lists_by_hand(spark, again):
    """Positions, lengths and vectors; a query without features gives no items but is met as zeros."""
    rows = busy_trace(120)
    want, by_id = lists_by_hand(rows, 50), {r[0]: r for r in rows}
    trace = spark.createDataFrame([*rows, *[rows[k] for k in again]], TRACE)
    features = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "query_idx int, features array<double>")
    got = sorted((tuple(r) for r in learn.sequence_features(trace, features, lookback_us=50).collect()), key=lambda r: (r[0], r[1]))
    out = []
    known = lambda i: [float(by_id[i][4]), 1.0] if by_id[i][4] < 4 else None
    for i in sorted(want):
        earlier, later, recent = want[i]
        recent = sorted(recent, key=lambda k: (by_id[k][2], k))
        times = 1 + (i in again)
        items = [*[(0, k) for k in recent], *[(1, k) for k in earlier], *[(2, None)] * times, *[(3, k) for k in later]]
        for place, (side, k) in enumerate(items, 1):
            if known(i):
                apart = (by_id[k][2] - by_id[i][2]) / 1e6 if k is not None else 0.0
                other = (known(k) if k is not None else None) or [0.0, 0.0]
                vector = [*known(i), float(side == 1), float(side == 3), *other, -abs(apart), float(side == 0), 0.0]
                out.append((i, place, side, k, len(recent) + len(earlier) + times, vector))
    assert got == out


def test_recent_finished_looks_back_as_far_as_the_source(spark, tmp_path):
    """A run that ended 199.9 s before a start is met, one that ended 200.9 s before it is not."""
    from querytide.registry import load

    events = spark.sql(
        """SELECT CAST(id AS BIGINT) AS event_id, 4L AS user_id, 'click' AS event_type, 0.1D AS value, '{"k": 1}' AS props,
  CAST(timestamp_seconds(1704067200 + start * 60) AS TIMESTAMP_NTZ) AS ts
FROM VALUES (0, -1), (1, 0), (2, 1), (3, 200) AS v(id, start)"""
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = load()[0]["conc_recent_finished"](spark, str(tmp_path))
    assert {(r.query_id, r.other_query_id) for r in got.collect()} == {(3, 1), (3, 2), (2, 1), (2, 0), (1, 0)}
