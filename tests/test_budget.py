import calendar
from datetime import date, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cashplan.operators import budget as pl
from helpers import D, m, plan_schedule, rows


def plan(spark, first, last, keep_phase=False, **rule):
    df = pl.planned_budget(plan_schedule(spark, {"Account_Name": "a"} | rule), D(first), D(last), keep_phase)
    return [r[0] for r in rows(df, "Date")]


def test_calendar(spark):
    df = pl.calendar(spark)
    assert df.count() == 36890
    assert rows(df.where("Date = DATE '2024-02-29'")) == [(D("2024-02-29"), 2024, 2, 29, 3)]
    edges = df.agg(F.min("Date"), F.max("Date")).first()
    assert tuple(edges) == (pl.CALENDAR_START, pl.CALENDAR_END)


def test_rule_views(spark):
    rules = plan_schedule(
        spark,
        {"Type": "monthly", "When": "5", "Account_Name": "m"},
        {"Type": "yearly", "When": "31-Dec", "Account_Name": "y"},
        {"Type": "oncely", "When": "2/3/2024", "Account_Name": "o"},
        {"Type": "biweekly", "When": "2/4/2024", "Account_Name": "b"},
        {"Type": "everyXDays", "When": "2/4/2024", "Account_Name": "e"},
    )
    validity = (D("2000-01-01"), D("2099-12-31"), m(-10))
    assert rows(pl.monthly_rules(rules)) == [("monthly", "m", 5, *validity)]
    assert rows(pl.yearly_rules(rules)) == [("yearly", "y", 12, 31, *validity)]
    assert rows(pl.one_time_rules(rules)) == [("oncely", "o", D("2024-02-03"), *validity)]
    assert rows(pl.biweekly_rules(rules)) == [("biweekly", "b", D("2024-02-04"), *validity)]


def test_validity_is_inclusive_and_open_ended(spark):
    rule = {"Type": "monthly", "When": "5", "Start_Date": "2/5/2024"}
    assert plan(spark, "2024-01-01", "2024-06-30", **rule, **{"Maturity Date": "4/5/2024"}) == [
        D("2024-02-05"),
        D("2024-03-05"),
        D("2024-04-05"),
    ]
    assert plan(spark, "2100-11-01", "2101-12-31", **rule, **{"Maturity Date": ""}) == [
        D("2100-11-05"),
        D("2100-12-05"),
    ]


def test_no_start_or_no_amount_is_never_planned(spark):
    rule = {"Type": "monthly", "When": "5"}
    assert plan(spark, "2024-01-01", "2024-12-31", **rule, Start_Date="") == []
    assert plan(spark, "2024-01-01", "2024-12-31", **rule, Amount=None) == []


def test_every_x_days_is_not_planned(spark):
    assert plan(spark, "2024-01-01", "2024-12-31", Type="everyXDays", When="1/1/2024", AfterDays="2") == []


def test_short_months_and_years(spark):
    assert plan(spark, "2024-01-01", "2024-04-30", Type="monthly", When="30") == [
        D("2024-01-30"),
        D("2024-03-30"),
        D("2024-04-30"),
    ]
    assert plan(spark, "2023-06-01", "2025-06-01", Type="yearly", When="1-Jun") == [
        D("2023-06-01"),
        D("2024-06-01"),
        D("2025-06-01"),
    ]


def test_biweekly_phase_resets_after_the_calendar_start(spark):
    rule = {"Type": "biweekly", "When": "1/5/2000"}
    assert plan(spark, "2000-01-01", "2000-01-31", **rule) == [
        D("2000-01-01"),
        D("2000-01-15"),
        D("2000-01-29"),
    ]
    assert plan(spark, "2000-01-01", "2000-01-31", keep_phase=True, **rule) == [
        D("2000-01-05"),
        D("2000-01-19"),
    ]
    early = {"Type": "biweekly", "When": "12/30/1999", "Start_Date": "1/1/1999"}
    assert plan(spark, "2000-01-01", "2000-01-31", **early) == [D("2000-01-13"), D("2000-01-27")]


def test_biweekly_occurrences(spark):
    rules = plan_schedule(
        spark,
        {"Type": "biweekly", "When": "12/20/1999", "Account_Name": "early"},
        {"Type": "biweekly", "When": "12/20/2050", "Account_Name": "late"},
    )
    df = pl.biweekly_occurrences(rules)
    per_rule = df.groupBy("Account_Name").agg(F.count(F.lit(1)), F.min("Date"))
    assert rows(per_rule) == [
        ("early", 2636, D("1999-12-20")),
        ("late", 2635, D("2000-01-01")),
    ]
    assert pl.biweekly_occurrences(rules.where("Type = 'monthly'")).count() == 0


def test_plan_order_and_columns(spark):
    rules = plan_schedule(
        spark,
        {"Type": "oncely", "When": "1/2/2024", "Account_Name": "small", "Amount": "1"},
        {"Type": "oncely", "When": "1/2/2024", "Account_Name": "large", "Amount": "9"},
        {"Type": "oncely", "When": "1/1/2024", "Account_Name": "first", "Amount": "0"},
    )
    df = pl.in_plan_order(pl.planned_budget(rules))
    assert df.columns == [*pl.CALENDAR_COLUMNS, "Type", "Account_Name", "Start_Date", "Maturity_Date", "Amount", "Row_Id"]
    assert [r.Account_Name for r in df.collect()] == ["first", "large", "small"]
    assert rows(df, "Year", "Month_of_Year", "Day_of_Month", "Day_of_Week")[0] == (2024, 1, 1, 0)


def test_equal_amounts_of_a_day_are_listed_by_kind_then_rule(spark):
    rules = plan_schedule(
        spark,
        *[
            {"Type": kind, "When": when, "Account_Name": f"{kind}{i}", "Amount": "5", "Maturity Date": "1/2/2000"}
            for i in range(3)
            for kind, when in [("biweekly", "1/1/2000"), ("oncely", "1/1/2000"), ("yearly", "1-Jan"), ("monthly", "1")]
        ],
    )
    listed = [r.Account_Name for r in pl.in_plan_order(pl.planned_budget(rules.repartition(5))).collect()]
    assert listed == [f"{kind}{i}" for kind in ["monthly", "yearly", "oncely", "biweekly"] for i in range(3)]


def naive(rule, day):
    """Whether a rule is planned on a day, asked day by day."""
    kind, when, start, maturity = rule
    if day < start or (maturity is not None and day > maturity):
        return False
    if kind == "oncely":
        return when == day
    if kind == "yearly":
        return (when.month, when.day) == (day.month, day.day)
    if kind == "monthly":
        return when.day == day.day
    return kind == "biweekly" and (day - min(when, pl.CALENDAR_START)).days % 14 == 0


date_of_rule = st.dates(date(1997, 1, 1), date(2004, 12, 31)).filter(lambda d: (d.month, d.day) != (2, 29))
drawn_rule = st.tuples(
    st.sampled_from(["oncely", "yearly", "monthly", "biweekly", "everyXDays"]),
    date_of_rule,
    date_of_rule,
    st.none() | date_of_rule,
)


@settings(max_examples=10, deadline=None)
@given(st.lists(drawn_rule, min_size=20, max_size=60), date_of_rule, st.integers(0, 900))
def test_plan_equals_asking_every_day(spark, drawn, first, length):
    last = first + timedelta(days=length)
    us = lambda d: f"{d.month}/{d.day}/{d.year}"
    form = {
        "yearly": lambda d: f"{d.day}-{calendar.month_abbr[d.month]}",
        "monthly": lambda d: str(d.day),
    }
    table = [
        {
            "Type": kind,
            "When": form.get(kind, us)(when),
            "Account_Name": f"n{i}",
            "Start_Date": us(start),
            "Maturity Date": "" if maturity is None else us(maturity),
        }
        for i, (kind, when, start, maturity) in enumerate(drawn)
    ]
    got = rows(pl.planned_budget(plan_schedule(spark, *table), first, last), "Account_Name", "Date")
    days = [first + timedelta(days=i) for i in range(length + 1)]
    planned = [d for d in days if d >= pl.CALENDAR_START]
    assert got == sorted((f"n{i}", d) for i, r in enumerate(drawn) for d in planned if naive(r, d))


def test_positions_are_those_of_the_order(spark):
    rules = plan_schedule(
        spark,
        *({"Type": kind, "When": when, "Account_Name": f"{kind}{i}", "Amount": str(-i % 3)} for i in range(6) for kind, when in (("monthly", "5"), ("oncely", "1/5/2024"))),
    )
    plan = pl.planned_budget(rules, D("2024-01-01"), D("2024-03-31"))
    columns = ["Date", "Amount", "Type", "Account_Name"]
    want = [tuple(r) for r in pl.in_plan_order(plan).select(*columns).collect()]
    placed = pl.with_plan_position(plan.repartition(5)).orderBy("Position").select("Position", *columns).collect()
    assert [tuple(r)[1:] for r in placed] == want and [r.Position for r in placed] == list(range(1, len(want) + 1))


def test_positions_of_amounts_alike_in_part_missing_or_huge(spark):
    """The number sorted by first never falls along the plan's order, and the calendar's parts are not laid out."""
    amounts = ["0.01", "-0.01", "0.99", "-0.99", "1000000001", "1000000002.50", "-1000000001", "-9999999999999999.99", None, "0.99"]
    cells = [(day, amount, kind) for day in ("2024-01-02", "1999-12-31", None) for amount in amounts for kind in pl.PLAN_KINDS]
    plan = spark.createDataFrame([(i, *cell) for i, cell in enumerate(cells)], "Row_Id long, Date string, Amount string, Type string")
    plan = pl.with_calendar_parts(plan.withColumns({"Date": F.col("Date").cast("date"), "Amount": F.col("Amount").cast("decimal(18,2)")}))
    want = [r.Row_Id for r in pl.in_plan_order(plan).collect()]
    placed = pl.with_plan_position(plan.repartition(7))
    assert placed.columns == [*plan.columns, "Position"]
    assert [r.Row_Id for r in placed.orderBy("Position").collect()] == want
    coarse = [r[0] for r in pl.in_plan_order(plan).select(pl._coarse_plan_order()).collect()]
    known = [x for x in coarse if x is not None]
    assert known == sorted(known) and coarse[: len(known)] == known and len(known) == 80
    scan = placed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[1]
    assert "Month_of_Year" not in scan and "Row_Id" in scan
