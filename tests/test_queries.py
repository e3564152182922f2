import pytest

from loomgraph.plans import catalog
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    agree(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    rows = [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]
    # the invented return types of the data are all declared or imported where they are used
    assert rows or name in ("x27_synthetic_types", "k05_file_errors")
    if name == "p3_intervals":
        assert len({(r[1], r[2]) for r in rows}) == len(rows) and all(r[2] <= r[3] for r in rows)
