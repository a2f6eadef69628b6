"""Every registered query against its check SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from querytide.fixtures import view
from querytide.registry import load
from tests.check import TESTDATA, check_connection, compare

SF_DIR = os.path.join(TESTDATA, os.environ.get("QUERYTIDE_TEST_SF", "sf0.001"))
# Their filters select nothing at the smallest scale.
EMPTY = {"fit_queueing_curve", "predict_queueing_curve", "q07", "q11", "q20", "q21"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return check_connection(SF_DIR)


@pytest.mark.parametrize("name", list(load()[0]))
def test_query(spark, con, name):
    problem = compare(spark, con, name, SF_DIR)
    assert problem == "" or (name in EMPTY and problem == "no rows on either side"), problem


def test_every_check_has_a_query():
    queries, checks = load()
    assert set(checks) <= set(queries)


def test_sequences_hold_short_neighbours(spark):
    trace = view(spark, SF_DIR, "trace").select(F.col("query_id").alias("other_query_id"), "run_us")
    found = load()[0]["seq_features"](spark, SF_DIR).join(trace, "other_query_id")
    assert found.where("run_us < 5000000").count() > 0
