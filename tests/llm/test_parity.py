"""Queries beside their DuckDB twins."""

import pytest

from tests.compare import compare, duck
from tillsight.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_twin(spark, name):
    problems, _, rows = compare(spark, duck(FOLDER), name, queries.register()[name], sql.ORACLES[name], FOLDER)
    assert not problems and rows
