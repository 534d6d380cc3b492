import pytest

from lexigrain import plans

from .oracle import both, connect

SF = "/root/testdata/sf0.001"
#: Nothing in the smallest tables passes these queries' thresholds.
MAY_BE_EMPTY = {"also_common", "one_sided_words", "keep_list", "site_drop"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n in plans.ORACLES])
def test_query_equals_sql(spark, con, name):
    ours, theirs = both(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name])
    assert ours == theirs
    assert ours or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.ORACLES])
def test_query_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
