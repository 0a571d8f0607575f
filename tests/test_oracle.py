"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from metricloom.plans import catalog
from tests.conftest import SF
from tests.oracle_check import compare


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["name", "window_start"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_query(spark, con, name):
    """A query without a twin fails here."""
    ok, note, _ = compare(spark, con, name, SF)
    assert ok is True, note
