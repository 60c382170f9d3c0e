"""Every query beside its SQL on a whole small table; those without SQL are held against brute force in the other files."""

import pytest

from lexiloom import plans

from .compare import both, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, con, name):
    got, want = both(spark, con, SF, plans.QUERIES[name], plans.ORACLE[name])
    assert got == want and (got or name == "near_dup_subgraph")


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
