"""Every registered query against its DuckDB statement at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from tests.support import compare


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, connection, sf_dir, name):
    verdict, count = compare(spark, connection, name, sf_dir)
    assert verdict in ("ok", "rows only"), verdict
    assert count > 0


def test_every_statement_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["categoria_producto_final", "ingreso_total"]
    assert frame.count() == 5
