import os

import pytest

from scenelake.llm.queries import ORACLES, QUERIES
from tests.compare import check, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows, problem = check(spark, connect(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert rows and not problem, problem


def test_registered():
    import __spark_entry__ as contract

    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
