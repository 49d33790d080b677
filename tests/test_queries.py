"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from episodica import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "null"
        v = v.item() if hasattr(v, "item") else v
        return repr(round(v, 6) + 0.0) if isinstance(v, float) and math.isfinite(v) else repr(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.SQL:
        assert len(got.columns)
        return
    want = db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "onset", "length"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["scan_pruned_frames"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(l_quantity,10.0)" in plan
    assert "l_extendedprice" not in plan


def test_records_of_drafts_are_dealt_once(spark):
    """One exchange, over as many tasks as the lines ask for."""
    plan = catalog.QUERIES["medoid"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("rangepartitioning", "")


def test_runs_of_few_documents_are_spelled_out(spark):
    """Runs as text only of documents whose hashes the held-out set has, from a table of these."""
    got = catalog.QUERIES["overlap_report"](spark, DATA)
    assert any("/maybe-" in f for f in got.inputFiles())
