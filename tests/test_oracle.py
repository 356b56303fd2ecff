"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest
from tripwire.plans.registry import ORACLE, REGISTRY

NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "task", "mean", "std", "n_runs", "label"]
    assert df.count() == 2  # the tasks with a triggered row


def test_entry_module_without_the_corpus_subpackage():
    """The other queries stay when the subpackage and its pipeline are absent as a whole."""
    import subprocess
    import sys

    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "names = set(e.queries()); assert names == set(e.oracle_sql()) and 'pipeline' not in names; print(len(names))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) == len(REGISTRY), done.stderr
