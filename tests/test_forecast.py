import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cashplan.operators import forecast as fc
from cashplan.operators import occurrences as occ
from helpers import D, ledger, m, rows, schedule

AS_OF = D("2024-01-10")
OPENING = 100


def entry(day, account, amount, **more):
    return {"Date": day, "Account_Name": account, "Amount": amount} | more


def ledger_only(df):
    return df.withColumns({"Source_Rank": F.lit(0), "Kind_Rank": F.lit(0)})


def test_retention(spark):
    df = ledger(
        spark,
        entry("2024-01-09", "past", "-1"),
        entry("2024-01-10", "today", "-2"),
        entry("2024-02-01", "paid", "-3", Amount_Paid="3"),
        entry("2024-02-01", "open", "-4", Amount_Paid="0"),
    )
    assert rows(fc.retained(df, AS_OF), "Account_Name") == [("paid",), ("past",)]


def test_missing_ledger_cells_count_as_zero(spark):
    df = ledger(spark, entry("2024-01-01", "a", None, Amount_Paid=None, Date_Paid=None))
    assert rows(fc.retained(df, AS_OF), "Amount", "Amount_Paid", "Date_Paid") == [(m(0), m(0), "0")]


def test_an_unpaid_entry_without_a_date_raises(spark):
    undated = entry("", "a", "-1")
    with pytest.raises(Exception, match="no date in unpaid ledger row 2"):
        fc.retained(ledger(spark, entry("2024-01-01", "b", "-1"), undated), AS_OF).collect()
    assert fc.retained(ledger(spark, undated | {"Amount_Paid": "1"}), AS_OF).count() == 1


def test_first_entry_of_a_date_and_account_stays(spark):
    known = fc.retained(
        ledger(
            spark,
            entry("2024-01-09", "Rent", "-1"),
            entry("2024-01-09", "Rent", "-2"),
            entry("2024-01-08", "Rent", "-3"),
        ),
        AS_OF,
    )
    rules = schedule(
        spark,
        {"Type": "everyXDays", "When": "1/9/2024", "AfterDays": "1", "Account_Name": "Rent", "Amount": "-4"},
        {"Type": "oncely", "When": "1/11/2024", "Account_Name": "Rent", "Amount": "-5"},
        {"Type": "oncely", "When": "1/11/2024", "Account_Name": "Rent", "Amount": "-6"},
    )
    df = fc.keep_first(fc.with_expected(known, occ.expected_entries(rules, AS_OF, 2, 2)))
    assert rows(df, "Date", "Amount") == [
        (D("2024-01-08"), m(-3)),
        (D("2024-01-09"), m(-1)),
        (D("2024-01-10"), m(-4)),
        (D("2024-01-11"), m(-5)),
        (D("2024-01-12"), m(-4)),
    ]


def test_expected_entry_without_amount_raises(spark):
    rules = schedule(spark, {"Type": "monthly", "When": "11", "Account_Name": "a", "Amount": None})
    known = fc.retained(ledger(spark, entry("2024-01-01", "a", "1")), AS_OF)
    assert occ.expected_entries(rules, AS_OF, 0, 5).count() == 1
    with pytest.raises(Exception, match="no amount in rule"):
        fc.with_expected(known, occ.expected_entries(rules, AS_OF, 0, 5)).collect()


def test_running_balance_skips_paid_entries(spark):
    df = ledger_only(
        ledger(
            spark,
            entry("2024-01-02", "a", "50"),
            entry("2024-01-02", "b", "-30"),
            entry("2024-01-01", "c", "-5", Date_Paid="2024-01-01"),
            entry("2024-01-03", "d", "-8", Date_Paid=None),
            entry("2024-01-03", "e", "-7", Date_Paid="0"),
        )
    )
    got = rows(fc.running_balance(df, OPENING), "Position", "Account_Name", "Running_Balance")
    assert got == [
        (1, "c", m(100)),
        (2, "b", m(70)),
        (3, "a", m(120)),
        (4, "d", m(112)),
        (5, "e", m(112)),
    ]


def test_equal_amounts_of_a_day_keep_their_order(spark):
    df = ledger_only(ledger(spark, *[entry("2024-01-01", f"n{i:02}", "-1") for i in range(20)]))
    got = rows(fc.running_balance(df, OPENING), "Position", "Account_Name", "Running_Balance")
    assert got == [(i + 1, f"n{i:02}", m(99 - i)) for i in range(20)]


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_running_balance_does_not_depend_on_partitions(spark, partitions):
    """A third of all rows on one day with one amount, against a loop over the sorted rows."""
    draw = random.Random(3)
    data = []
    for i in range(3000):
        hot = i % 3 == 0
        day = D("2024-01-05") if hot else D("2024-01-01") + timedelta(days=draw.randrange(30))
        data.append((i, day, m(-1) if hot else m(draw.randrange(-900, 900)), draw.choice(["", "x", None])))
    draw.shuffle(data)
    df = spark.createDataFrame(data, "Row_Id long, Date date, Amount decimal(18,2), Date_Paid string")
    total, want = m(100), []
    ordered = sorted(data, key=lambda r: (r[1], r[2], r[0]))
    for position, (row_id, _, amount, paid) in enumerate(ordered, start=1):
        total += amount if not paid else 0
        want.append((position, row_id, total))
    settings = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        placed = fc.in_order(ledger_only(df))
        got = rows(fc.run_up(placed, OPENING), "Position", "Row_Id", "Running_Balance")
        if partitions == "16":
            share = placed.groupBy("Part").count().agg(F.max("count")).first()[0]
            assert share < 1000, "a hot day is split over partitions"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == want


@pytest.fixture(scope="module")
def small(spark):
    known = ledger(
        spark,
        entry("2023-12-31", "old", "-40"),
        entry("2024-01-08", "Car", "-60", Type="oncely"),
        entry("2024-02-01", "Job", "500", Amount_Paid="500", Date_Paid="2024-01-09"),
    )
    rules = schedule(
        spark,
        {"Type": "everyXDays", "When": "1/10/2024", "AfterDays": "10", "Account_Name": "Food", "Amount": "-20"},
        {"Type": "oncely", "When": "1/20/2024", "Account_Name": "Gift", "Amount": "-15"},
        {"Type": "oncely", "When": "1/20/2024", "Account_Name": "Refund", "Amount": "5", "Priority": "2"},
        {"Type": "monthly", "When": "25", "Account_Name": "Wage", "Amount": "1000"},
    )
    entries = fc.entries_to_date(known, rules, AS_OF, 5, 30)
    return entries, rules


def test_forecast_reports(small):
    entries, rules = small
    rows_of = fc.running_balance(entries, OPENING)
    daily = fc.ending_daily_balance(entries, OPENING)
    assert rows(daily) == rows(fc.ending_daily_balance_of(rows_of))
    assert rows(daily, "Date", "Running_Balance") == [
        (D("2023-12-31"), m(60)),
        (D("2024-01-08"), m(0)),
        (D("2024-01-10"), m(-20)),
        (D("2024-01-20"), m(-50)),
        (D("2024-01-25"), m(950)),
        (D("2024-01-30"), m(930)),
        (D("2024-02-01"), m(930)),
        (D("2024-02-09"), m(910)),
    ]
    assert rows(fc.label_dates(entries)) == [
        (D("2024-01-08"), "Car", m(-60)),
        (D("2024-01-20"), "Gift", m(-15)),
        (D("2024-01-20"), "Refund", m(5)),
    ]
    # the eighth is more than one day before the tenth
    assert rows(fc.alert_dates(daily, AS_OF, threshold=0)) == [
        (D("2024-01-10"), m(-20)),
        (D("2024-01-20"), m(-50)),
    ]
    assert len(rows(fc.alert_dates(daily, AS_OF))) == 6
    assert rows(fc.first_alerts(fc.alert_dates(daily, AS_OF), 1), "Date") == [(D("2024-01-10"),)]
    assert [r.Label_Item for r in fc.first_labels(entries, 2).collect()] == ["Car", "Gift"]


def test_daily_balance_report(small):
    entries, rules = small
    daily = fc.ending_daily_balance(entries, OPENING)
    report = fc.daily_balance_report(daily, fc.label_dates(entries), occ.emergency_fund(rules), AS_OF)
    assert report.columns == [
        "Date",
        "Running_Balance",
        "Label_Item",
        "Label_Amount",
        "Emergency_Fund_Amount",
        "Alert_Threshold",
        "Zero",
    ]
    got = rows(report.withColumn("Date", F.col("Date").cast("date")))
    constants = (m(-180), 1000, 0)
    assert got[:4] == [
        (D("2023-12-31"), m(60), "", None, *constants),
        (D("2024-01-08"), m(0), "Car", m(-60), *constants),
        (D("2024-01-10"), m(-20), "", None, *constants),
        (D("2024-01-20"), m(-50), "Gift", m(-15), *constants),
    ]
    assert len(got) == 9
    later = fc.daily_balance_report(daily, fc.label_dates(entries), occ.emergency_fund(rules), D("2024-01-18"))
    assert later.agg(F.min("Date").cast("date")).first()[0] == D("2024-01-08")


def test_reports_read_only_what_they_need_of_a_layout(small, capsys):
    entries, rules = small
    placed = fc.in_order(entries)
    daily = fc.ending_daily_balance(placed, OPENING)
    report = fc.daily_balance_report(daily, fc.label_dates(placed), occ.emergency_fund(rules), AS_OF)
    capsys.readouterr()
    report.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(Date,2023-12-31)" in plan and "EqualTo(Type,oncely)" in plan
    scanned = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert scanned and not any("Category" in line or "Auto_Pay_Account" in line for line in scanned)
    assert rows(report.withColumn("Date", F.col("Date").cast("date"))) == rows(
        fc.daily_balance_report(
            fc.ending_daily_balance(entries, OPENING), fc.label_dates(entries), occ.emergency_fund(rules), AS_OF
        ).withColumn("Date", F.col("Date").cast("date"))
    )
