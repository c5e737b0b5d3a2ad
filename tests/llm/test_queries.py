import re

import pytest

from check import compare, connect
from passagework.llm.queries import QUERIES
from passagework.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert re.match(r"ok \(\d+ rows\)$", compare(got, con.execute(ORACLES[name]).df()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_native_plans(spark, plan):
    for name in ("op1_tool_links", "op5_quality_rules", "op6_license_rules"):
        assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, SF)))
