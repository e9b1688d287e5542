"""Every query of the catalogue against DuckDB."""

import pytest

from columnade import queries


@pytest.mark.parametrize("name", list(queries.CATALOGUE))
def test_same_as_duckdb(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.CATALOGUE])
def test_host_like_duckdb(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])
