"""Every registered query against its SQL."""

import pytest

from checks.compare import compare, duck
from checks.queries import ORACLES, QUERIES
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, note = compare(spark, con, SF, name)
    assert verdict == "ok", note
    assert "types" not in note, note


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.queries()) >= set(__spark_entry__.oracle_sql())
