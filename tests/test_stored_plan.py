"""The plan kept by month: the rows of a window or of some days, and which months are read for them."""

import pytest
from pyspark.sql import functions as F

from cashplan.operators import budget, stored_plan
from cashplan.sources.tables import TableStore
from helpers import D, plan_schedule, rows

NAME = "Planned_Budget"
COLUMNS = ["Date", "Type", "Account_Name", "Amount", "Row_Id"]


@pytest.fixture(scope="module")
def plan(spark):
    return budget.planned_budget(
        plan_schedule(
            spark,
            {"Type": "monthly", "When": "31", "Account_Name": "Rent"},
            {"Type": "biweekly", "When": "1/7/2000", "Account_Name": "Pay", "Amount": "5.00"},
            {"Type": "yearly", "When": "28-Feb", "Account_Name": "Fee"},
            {"Type": "oncely", "When": "10/2/2000", "Account_Name": "Gift"},
        )
    )


@pytest.fixture(scope="module")
def store(spark, plan, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("plan")))
    stored_plan.store_plan(store, plan, NAME)
    return store


def days(spark, *texts):
    return spark.createDataFrame([(text and D(text), 1) for text in texts], "Date date, Kind int")


def files_read(df):
    """Files that the scan of the stored plan read, once run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.nodeName() else leaf
        if "Scan parquet" in leaf.nodeName():
            return leaf.metrics().apply("numFiles").value()
    raise AssertionError(plan.toString())


def test_a_window_equals_the_plan_and_reads_its_months(spark, plan, store):
    window = D("2000-09-20"), D("2000-11-10")
    got = stored_plan.stored_window(store, NAME, *window)
    assert rows(got, *COLUMNS) == rows(plan.where(F.col("Date").between(*window)), *COLUMNS)
    assert got.columns == plan.columns
    assert 1 <= files_read(stored_plan.stored_window(store, NAME, *window)) <= 6


def test_days_of_another_table_equal_the_plan_and_prune_months(spark, plan, store):
    asked = days(spark, "2000-10-02", "2000-10-31", "2000-10-31", "2004-02-28", "2200-01-01", None)
    got = stored_plan.on_days(store, NAME, asked)
    known = [D("2000-10-02"), D("2000-10-31"), D("2004-02-28")]
    assert rows(got, *COLUMNS) == rows(plan.where(F.col("Date").isin(known)), *COLUMNS)
    assert got.columns == plan.columns
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert 1 <= files_read(stored_plan.on_days(store, NAME, asked)) <= 4 < store.read(NAME).select("Plan_Month").distinct().count()


def test_no_days_and_no_plan(spark, plan, store, tmp_path):
    assert stored_plan.on_days(store, NAME, days(spark)).count() == 0
    assert stored_plan.on_days(store, NAME, days(spark, None)).count() == 0
    wide = days(spark, "2000-10-31").withColumn("Amount", F.lit(1))
    assert stored_plan.on_days(store, NAME, wide).columns == plan.columns
