"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from emberline.plans import registry  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    twins = entry.oracle_sql()
    assert name in twins
    assert compare.difference(df, con, twins[name]) is None


def test_a_difference_is_noticed(spark, con):
    df = entry.queries()["risk_tiers"](spark, FOLDER)
    sql = entry.oracle_sql()["risk_tiers"]
    assert compare.difference(df, con, f"SELECT customer_id, snapshot_date, risk_score + 0.0001 AS risk_score, risk_tier FROM ({sql})")
    assert compare.difference(df, con, f"SELECT * FROM ({sql}) LIMIT 10")
    assert compare.difference(df, con, f"SELECT *, 1 AS more FROM ({sql})")


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
