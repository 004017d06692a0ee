"""Every query that has SQL gives the rows of its SQL in DuckDB."""

import oracle
import pytest

from tallyforge import catalog

SF = f"{oracle.DATA}/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert oracle.compare(catalog.queries()[name](spark, SF), con, SQL[name]) == ""


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r["verdict"] for r in rows} <= {"slop", "kinda_slop", "clean"}
