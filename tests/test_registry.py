"""Every registered query against its SQL on the smallest tables; those without SQL have to run and give rows."""

import pytest
from conftest import DATA, rows_of

from tessera.plans.registry import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = queries()[name](spark, DATA).toPandas()
    assert rows_of(got) == rows_of(duck.execute(oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"text_classifier"}))
def test_runs(spark, duck, name):
    assert queries()[name](spark, DATA).columns


def test_classifier_learns(spark, duck):
    row = queries()["text_classifier"](spark, DATA).first()
    assert row.n > 0 and row.accuracy > 0.7


def test_entry_works_without_the_optional_folders(spark, duck):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(oracle_sql()) <= set(e.oracle_sql()) and set(queries()) <= set(e.queries())
