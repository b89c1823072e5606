"""Every registered query of the engine proper runs on the small tables and equals its SQL."""

import pytest

from tests.oracle import connect, same
from tidemark import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(name, spark, sf, con):
    same(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    from tests.conftest import ROOT

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "True"
