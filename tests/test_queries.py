"""Each query of the catalogue agrees with its SQL; those without SQL run and give rows."""

from __future__ import annotations

import pytest

from proofsheet.plans import catalog
from tests.compare import DATA, differences

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, catalog.queries()[name], SQL[name], f"{DATA}/sf0.01") == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, f"{DATA}/sf0.001").count() > 0
