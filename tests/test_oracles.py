"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from scorelake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return made


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def _rows(frame):
    return sorted(tuple(map(_plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", ["bootstrap_ci_md5", "bootstrap_ci_numpy", "bootstrap_macro_ci_md5", "paired_bootstrap_md5"])
def test_full_number_of_replicates(spark, name):
    assert catalogue.QUERIES[f"{name}_5000"](spark, DATA).first().n_boot == 5000
