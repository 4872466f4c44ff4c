import pytest

from tests.oracle import check
from voxelspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, name):
    check(spark, catalog.QUERIES[name], catalog.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    """What these give is held against numpy and brute force in the other tests; here, that there is something, without nulls in places or ids."""
    df = catalog.QUERIES[name](spark, FOLDER).cache()
    assert df.count() > 0
    keys = [c for c in df.columns if c in ("z", "y", "x", "value", "fragment", "segment", "label", "component", "id")]
    assert not keys or df.dropna(subset=keys).count() == df.count()
    df.unpersist()


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row["voi_merge"] >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
