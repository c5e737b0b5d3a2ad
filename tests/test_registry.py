import re

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.QUERIES, entry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert re.match(r"ok \(\d+ rows\)$", compare(got, con.execute(ORACLES[name]).df()))
    else:
        assert len(got) > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"related_banded"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "path", "chunk_no", "score"]
