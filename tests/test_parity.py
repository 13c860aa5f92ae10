"""Every registered query against its SQL on the smallest data, and the registry's own rules."""

import re
from pathlib import Path

import pytest
from parity import NO_SQL, compare, duck

from gridwatt.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, FOLDER)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_queries_without_sql_are_listed_with_a_test_that_is_there():
    assert set(queries()) - set(oracle_sql()) == set(NO_SQL)
    there = re.findall(r"^def (test_\w+)", (Path(__file__).parent / "test_operators.py").read_text(), re.M)
    assert set(NO_SQL.values()) <= set(there)
