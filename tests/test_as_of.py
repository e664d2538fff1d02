"""Balances on given days, against a plain look-up."""

import random

import pytest
from pyspark.sql import functions as F

from cashplan.operators import as_of
from cashplan.operators.as_of import balances_as_of
from cashplan.session import written
from helpers import D, m

BALANCES = "Row_Id long, Date date, Account_Name string, Balance decimal(28,8)"
QUESTIONS = "Nth long, Account_Name string, Date date, Note string"


def day(n):
    return D("2024-01-01").fromordinal(D("2024-01-01").toordinal() + n)


def plain(questions, snapshots):
    out = []
    for nth, account, on, note in questions:
        known = [
            (date, -row, balance)
            for row, date, name, balance in snapshots
            if None not in (date, name, balance, account, on) and name == account and date <= on
        ]
        date, _, balance = max(known, key=lambda x: x[:2]) if known else (None, None, None)
        out.append((nth, account, on, note, date, balance))
    return sorted(out, key=str)


@pytest.fixture(autouse=True)
def uncoalesced(spark):
    """Small ranges stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("row_id", [None, "Nth"])
def test_against_a_plain_look_up(spark, ranges, row_id):
    rng = random.Random(ranges)
    names = ["a"] * 6 + ["b", "c", "d"]
    snapshots = [(i, day(rng.randrange(60)), rng.choice(names), rng.choice([None, m(i), m(-i)])) for i in range(120)]
    snapshots += [(500, None, "a", m(1)), (501, day(3), None, m(2)), (502, day(70), "a", m(3)), (503, day(70), "a", m(4))]
    questions = [(i, rng.choice([*names, "none"]), day(rng.randrange(-5, 90)), "x") for i in range(300)]
    questions += [(900, None, day(5), "x"), (901, "a", None, None), (902, "b", None, "y")]
    if not row_id:
        questions += [(7, "a", day(20), "same")] * 50  # alike in every column
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        asked, known = spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(snapshots, BALANCES)
        got = balances_as_of(asked, known, row_id)
        assert got.columns == ["Nth", "Account_Name", "Date", "Note", "Balance_Date", "Balance"]
        rows = [(*r[:5], None if r[5] is None else m(r[5])) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(rows, key=str) == plain(questions, snapshots)


def test_one_account_is_split_and_its_balance_carried_on(spark, monkeypatch):
    """One snapshot, and the questions of its account in several ranges after it."""
    known = spark.createDataFrame([(1, day(0), "a", m(5))], BALANCES)
    asked = spark.range(5000).select(
        F.col("id").alias("Nth"), F.lit("a").alias("Account_Name"), F.lit(day(9)).alias("Date"), F.lit("").alias("Note")
    )
    laid = []
    monkeypatch.setattr(as_of, "written", lambda df: laid.append(written(df)) or laid[-1])
    assert as_of.balances_as_of(asked, known, "Nth").where("Balance = 5").count() == 5000
    parts = [r["count"] for r in laid[0].groupBy("_Part").count().collect()]
    assert len(parts) == 8 and max(parts) < 2000


def test_empty_tables_and_clashing_names(spark):
    known, asked = spark.createDataFrame([], BALANCES), spark.createDataFrame([(1, "a", day(1), "x")], QUESTIONS)
    assert [r.Balance for r in balances_as_of(asked, known).collect()] == [None]
    assert balances_as_of(asked.limit(0), known).count() == 0
    with pytest.raises(ValueError, match="Balance"):
        balances_as_of(asked.withColumn("Balance", F.lit(1)), known)
