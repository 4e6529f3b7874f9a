import pytest

from claimloom.plans import lookups, registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_its_sql(spark, sf, name):
    if name in registry.ORACLE_SQL:
        assert compare(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name]) is None
    else:
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_repeated_lookups_are_asked_once(spark, sf):
    asked = [r["asked"] for r in lookups.j10_misses(spark, sf).collect()]
    assert max(asked) > 1
    hits = lookups.j10(spark, sf).filter("lookup_status IS NOT NULL")
    assert hits.groupBy("lookup_key").count().filter("count > 1").count() > 0
