"""Every registered query against the same query in plain SQL, on the ordinary and on the hot-key route."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import connect, mismatch
from wrenchline.plans.oracle import ORACLE
from wrenchline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SKEW_AWARE = ["update_by_key", "audit_foreign_key", "cascade_rename", "vehicle_gate", "part_gate", "receipt_remaining",
              "pending_stock", "allocate_fifo", "allocate_receipts", "unmatched_receipts", "recent_prefix_size",
              "recent_assignments", "assign_mechanics", "unused_parts_by_category", "stream_receipts"]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= contract.queries().items() and ORACLE.items() <= contract.oracle_sql().items()


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).columns == ["order_id", "status"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    assert mismatch(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) == ""


@pytest.mark.parametrize("name", SKEW_AWARE)
def test_same_rows_with_hot_keys(hot_spark, duck, name):
    assert mismatch(QUERIES[name](hot_spark, FOLDER), duck, ORACLE[name]) == ""
