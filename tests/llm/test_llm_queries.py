import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same  # noqa: E402

from canvass.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


def test_one_query_for_each_operator_and_the_pipeline():
    import __spark_entry__

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
