"""Every training-data query that has SQL, against it."""

import sys
from pathlib import Path

import pytest
from dyadica.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from sql_check import differences  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == []
