"""The register of queries."""

import pytest

import __spark_entry__ as entry
from tidewire import catalog


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        catalog.query("acquisition_listing", "relationships entities")
    assert len(catalog.queries()) == len(catalog._REGISTER)


def test_listings_keep_their_own_sql():
    """The listing of 200 classified acquisitions, beside the command line's 20."""
    sql = entry.oracle_sql()
    assert sql["acquisition_listing"].endswith("LIMIT 200") and "source_label" in sql["acquisition_listing"]
    assert sql["newest_acquisitions"].endswith("LIMIT 20")
