"""Registered queries of the core against their SQL on the smallest tables, where these are at hand."""

from pathlib import Path

import duckdb
import pytest

from lexloom.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    made = duckdb.connect()
    made.sql("SET timezone = 'UTC'")
    for file in FOLDER.glob("*.parquet"):
        made.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return made


@pytest.mark.parametrize("name", sorted(set(registry.queries()) & set(registry.oracle_sql())))
def test_query(spark, sql, name):
    ours = registry.queries()[name](spark, str(FOLDER)).toArrow()
    theirs = sql.sql(registry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(theirs.column_names)
    assert columns == sorted(ours.column_names)
    rows = lambda t: sorted(map(str, zip(*[t[c].to_pylist() for c in columns])))
    assert rows(ours) == rows(theirs)


def test_plans(spark):
    """Filters and columns reach the scan."""
    plan = registry.queries()["list_documents"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "full_text" not in plan and "PushedFilters: [IsNotNull(session_id), EqualTo(session_id" in plan
