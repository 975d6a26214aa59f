"""Every catalogue query against DuckDB on the smallest tables."""

import pytest
from conftest import SF, rows_of

import __spark_entry__ as entry
from shellac.plans import queries as catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert rows_of(got.toPandas()) == rows_of(duck.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registries(spark):
    assert entry.entry(spark).columns == ["pos", "id", "track_title", "artist", "origin", "tags"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['shellac.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'library_all' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.HERE)
