"""The registered queries: check SQL where there is one, and the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from querytide.llm.registry import CHECK, QUERIES
from tests.check import TESTDATA, _rows, check_connection

SF_DIR = os.path.join(TESTDATA, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", CHECK)
def test_check_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = check_connection(SF_DIR).execute(CHECK[name])
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["language_id", "line_dedup", "ngram_join", "secret_scan", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == counts[4]
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
