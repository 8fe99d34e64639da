"""Registered queries against their SQL on the smallest supplied tables."""

import os

import pytest

import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are absent")

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

#: Their plans are run over small panels by ``test_models`` and ``test_staged``.
SLOW = {"task_evaluation", "two_stage_models", "baseline_research", "move_search", "three_class_search", "seed_stability", "post_analysis"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    problem, *_ = oracle.compare(con, spark, QUERIES[name], SQL[name], SF)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 18
