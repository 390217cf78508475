"""Every query on the reference tables against its DuckDB twin, and the driver's contract."""

import pytest

from spindrift.plans import catalog
from tests.oracle import assert_same, duck

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_twin(spark, data_dir, name):
    got = catalog.queries()[name](spark, data_dir).toPandas()
    if name in ORACLE:
        assert_same(got, duck(ORACLE[name], data_dir))
    else:
        assert len(got)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
