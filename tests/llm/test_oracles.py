"""Corpus queries against their SQL."""

import pytest

import oracle
from panelkit.llm import queries


@pytest.mark.parametrize("size", ["small", "medium"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_corpus_query_equals_sql(spark, request, name, size):
    folder = request.getfixturevalue(size)
    found = queries.queries()[name](spark, folder)
    assert oracle.differences(found, queries.oracle_sql()[name], oracle.connection(folder)) == ""
