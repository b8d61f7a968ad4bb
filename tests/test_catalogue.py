"""Every query against its SQL."""

import pytest

import __spark_entry__
from ledgerline.plans import catalogue
from tests.oracle import compare

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name, folder):
    compare(catalogue.QUERIES[name](spark, folder), catalogue.ORACLES[name], folder)


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
