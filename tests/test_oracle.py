"""Every registered query against its SQL answer, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from barloom.plans.catalogue import catalogue
from tools.check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"
PLANS = {name: item.plan for name, item in catalogue().items()}
ANSWERS = {name: item.sql for name, item in catalogue().items() if item.sql is not None}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    line, ok = compare(spark, con, name, PLANS[name], ANSWERS.get(name), SF)
    assert ok, line


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_answer_has_a_query():
    assert set(ANSWERS) <= set(PLANS) <= set(queries())
    assert set(oracle_sql()) <= set(queries())
