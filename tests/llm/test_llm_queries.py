"""Every text query over its whole table, against its SQL where there is one."""

import os

import pytest
from oracle import compare, connect

from tabloom.llm.queries import QUERIES

FOLDER = os.environ.get("TABLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    run, sql = QUERIES[name]
    if sql:
        compare(run(spark, FOLDER), connect(FOLDER), sql)
    else:
        assert run(spark, FOLDER).count() > 0
