import pytest
from oracle import connect, rows_of_duck, rows_of_spark

from veilspark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    names, rows = rows_of_spark(queries.QUERIES[name](spark, SF))
    if name in queries.ORACLES:
        want_names, want = rows_of_duck(db, queries.ORACLES[name])
        assert names == want_names
        wrong = [(a, b) for a, b in zip(rows, want) if a != b]
        assert len(rows) == len(want) and not wrong[:2]
    assert rows
