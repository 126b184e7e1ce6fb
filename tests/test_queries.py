"""Every registered query of the engine against its SQL."""

import pytest
from oracle import compare, connect

from cairnflow import queries

#: Why a query has no SQL: text assembly or folds of plain Python; tested by their own tests.
NO_SQL = {"parent_child_chunks", "hierarchical_chunks", "tree_chunks", "graph_context", "box_suppression", "html_sections", "retrieve_context", "strategy_chunks", "table_html_spans"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(spark, sf_dir, name, queries.QUERIES[name], queries.ORACLES[name], con) is None


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
