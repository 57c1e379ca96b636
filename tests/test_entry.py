"""The driver contract: names, oracles, and a smoke run of the flagship query."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
