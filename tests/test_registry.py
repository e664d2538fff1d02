"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cashplan import session
from cashplan.plans import oracle, registry

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
        elif pd.api.types.is_numeric_dtype(frame[name]):
            frame[name] = frame[name].astype("float64")
        else:
            frame[name] = frame[name].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
    return pd.util.hash_pandas_object(frame, index=False).sort_values().tolist()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    duck.sql(ORACLE[name]).create_view("stored", replace=True)
    got, want = QUERIES[name](spark, str(SF_DIR)).toPandas(), duck.execute("SELECT * FROM stored").df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and canonical(got) == canonical(want)


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", QUERIES)
def test_no_query_joins_without_a_key_or_runs_python(spark, name):
    plan = plan_of(QUERIES[name](spark, str(SF_DIR)))
    for node in ["CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "InPandas"]:
        assert node not in plan


@pytest.mark.parametrize(
    "name", ["expected_occurrences", "planned_budget", "plan_biweekly_occurrences", "bank_classified"]
)
def test_expansions_and_projections_neither_join_nor_sort(spark, name):
    plan = plan_of(QUERIES[name](spark, str(SF_DIR)))
    assert "Join" not in plan and "Sort" not in plan


def test_first_entries_are_picked_before_the_shuffle_too(spark):
    assert plan_of(QUERIES["dedup_keep_first"](spark, str(SF_DIR))).count("WindowGroupLimit (") >= 2


@pytest.mark.parametrize("name", ["daily_balance_report", "summary_top30"])
def test_reports_expand_rules_and_read_the_ledger_once(spark, monkeypatch, name):
    """All of that is in the plan of the one table that the report's parts read."""
    plans = []
    monkeypatch.setattr(registry, "written", lambda df: plans.append(plan_of(df)) or session.written(df))
    report = plan_of(QUERIES[name](spark, str(SF_DIR)))
    assert len(plans) == 1 and plans[0].count("orders.parquet") == 1
    expansions = plan_of(QUERIES["dedup_keep_first"](spark, str(SF_DIR))).count("Generate (")
    assert plans[0].count("Generate (") == expansions and "Generate" not in report
    assert "orders.parquet" not in report and "WindowGroupLimit" not in report


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "Running_Balance" in df.columns
