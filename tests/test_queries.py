"""Every query of the engine against its SQL, at the smallest scale."""

import pytest
from emberline.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracles()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, check_rows, name):
    df = catalog.queries()[name](spark, SF)
    if name in ORACLES:
        check_rows(df, ORACLES[name])
    else:
        assert df.collect()


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["rank", "i", "h", "role"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
