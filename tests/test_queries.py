"""Every registered query of the library against its SQL."""

import pytest
from tables import duck, same_rows

from rarebucket.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, sf, name):
    same_rows(catalog.QUERIES[name](spark, sf).toPandas(), duck(sf).sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert {r.sketch_id for r in entry.entry(spark).collect()} == {"A", "N", "R"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
