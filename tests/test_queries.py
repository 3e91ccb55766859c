"""Every registered query against its SQL equivalent."""

import os

import pytest
from oracle import compare, connect

from tabloom.queries import registered

FOLDER = os.environ.get("TABLOOM_TEST_DATA", "/root/testdata/sf0.001")
ENTRIES = registered()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e[1]))
def test_matches_sql(spark, con, name):
    run, sql = ENTRIES[name]
    compare(run(spark, FOLDER), con, sql)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if not e[1]))
def test_gives_rows(spark, name):
    run, _ = ENTRIES[name]
    assert run(spark, FOLDER).count() > 0
