"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodeworks.plans.job_oracles import JOB_SQL
from lodeworks.plans.oracles import ORACLE_SQL as OWN_SQL
from lodeworks.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE_SQL = OWN_SQL | JOB_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"split_assignment_blake2b", "source_draws", "pass_order", "mixture_batches", "tokenizer_file_ids"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    sql = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(sql.columns)
    order = [sql.columns.index(c) for c in got.columns]
    want = [tuple(plain(r[i]) for i in order) for r in sql.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=str) == sorted(want, key=str)
