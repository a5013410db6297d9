import pytest

from tessella.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_sql(spark, duck, name):
    duck(spark, registry.queries()[name], registry.oracles()[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
