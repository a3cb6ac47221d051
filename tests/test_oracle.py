"""Every registered query against its SQL on whole tables of the smallest scale."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from vitrina.checks.compare import connect, difference
from vitrina.checks.oracle import ENGLISH
from vitrina.functions.stopwords import language_stop_words

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_sql_needs_no_session():
    code = "import __spark_entry__ as e; assert e.oracle_sql() and e.queries()"
    root = Path(entry_module.__file__).parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_english_words_are_those_of_spark(spark):
    assert language_stop_words("english") == ENGLISH


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and sum(r["items"] for r in rows) == 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, QUERIES[name], SQL.get(name), sf_dir) == ""
