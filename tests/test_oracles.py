import pytest

from cladeflow.plans import alignments, assembly, core_problems, dynamics, files, inference, models, networks, statistics, streams
from tests.oracle import DATA, check, needs_data

MODULES = (core_problems, statistics, alignments, networks, dynamics, models, assembly, inference, files, streams)
SQL = {k: (m.QUERIES[k], s) for m in MODULES for k, s in m.ORACLE.items()}
PLAIN = {k: f for m in MODULES for k, f in m.QUERIES.items() if k not in m.ORACLE}


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    check(spark, *SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(PLAIN))
def test_runs(spark, name):
    df = PLAIN[name](spark, DATA)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
