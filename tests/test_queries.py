import pytest

from lodestone.plans import catalog
from tests.conftest import SF, multiset


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 or name in ("fts_all_terms", "facts_hint_like")
    if name in catalog.ORACLES:
        assert multiset(got) == multiset(duck.execute(catalog.ORACLES[name]).df())


def test_entry_points_import_without_the_llm_package():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
