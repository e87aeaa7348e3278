import pytest

from beamframe.plans import ALL
from tests.compare import rows, same, sql_rows


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_same_rows_as_sql(spark, small, name):
    q = ALL[name]
    mine = q.build(spark, small)
    theirs = sql_rows(small, q.sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert same(rows(mine.toPandas()), rows(theirs))


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if not q.sql])
def test_runs_and_repeats(spark, small, name):
    a, b = (rows(ALL[name].build(spark, small).toPandas()) for _ in range(2))
    assert a == b and a


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
