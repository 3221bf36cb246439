"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest

from caseflow import catalog

from .compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
