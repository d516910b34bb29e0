import __spark_entry__ as entry
from pkgscreen.oracle import CHECKS
from pkgscreen.plans import QUERIES


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
