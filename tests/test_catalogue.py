import pytest

from chronoweave.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.ORACLE:
        compare(df, catalogue.ORACLE[name], small)
    else:
        assert df.columns and df.count() >= 0
