"""Every registered query over the graph gives the rows of its SQL; the entry points are whole."""

import pytest
from oracle import differ

import __spark_entry__ as entry
from lodestone.oracles import ORACLES as GRAPH_ORACLES
from lodestone.oracles_extract import ORACLES as EXTRACT_ORACLES
from lodestone.queries import QUERIES as GRAPH_QUERIES
from lodestone.queries_extract import QUERIES as EXTRACT_QUERIES

QUERIES, ORACLES = GRAPH_QUERIES | EXTRACT_QUERIES, GRAPH_ORACLES | EXTRACT_ORACLES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert differ(spark, sf_dir, QUERIES[name], ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
