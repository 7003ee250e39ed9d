"""Registered queries against their independent SQL. All of them with CHECK_ALL=1, else one in four."""

import os

import pytest

import __spark_entry__ as entry
import check
from conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in SQL if n in QUERIES)
if not os.environ.get("CHECK_ALL"):
    NAMES = NAMES[::4]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    status, _, note = check.compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert status == "ok", note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
