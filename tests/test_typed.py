from decimal import Decimal

import pytest

from cashplan import schemas
from cashplan.functions import cells
from cashplan.operators import occurrences, typed
from helpers import D, income_expense, m, plan_schedule, rows, schedule, text_frame


def one(df, name):
    return df.select(f"`{name}`").first()[0]


def test_schedule_types(spark):
    rule = {
        "Type": "monthly",
        "When": "5",
        "Account_Name": "Rent",
        "Limit": "500",
        "Interest Rate": "12.5%",
        "Payoff Order": "3",
        "Maturity Date": "2/29/2024",
    }
    df = schedule(spark, rule)
    assert one(df, "Amount") == m(-10) and one(df, "AfterDays") == 0 and one(df, "Limit") == m(500)
    assert one(df, "Balance") == m(0) and one(df, "Interest Rate") == 0.125 and one(df, "Payoff Order") == 3
    assert one(df, "Maturity Date") == D("2024-02-29") and one(df, "Start_Date") == "1/1/2000"


def test_blank_is_zero_but_null_stays_null(spark):
    df = schedule(spark, {"Balance": "", "Interest Rate": "", "Limit": None, "Maturity Date": ""})
    assert one(df, "Balance") == m(0) and one(df, "Interest Rate") == 0.0
    assert one(df, "Limit") is None and one(df, "Maturity Date") is None


@pytest.mark.parametrize(
    "name, cell",
    [
        ("Amount", ""),
        ("Amount", "ten"),
        ("AfterDays", ""),
        ("AfterDays", "3.0"),
        ("AfterDays", None),
        ("Payoff Order", None),
        ("Payoff Order", " "),
        ("Limit", " "),
        ("Interest Rate", "high"),
        ("Maturity Date", "someday"),
    ],
)
def test_bad_cells_raise(spark, name, cell):
    with pytest.raises(Exception):
        schedule(spark, {name: cell}).select(f"`{name}`").collect()


def test_money_that_was_worked_out_keeps_its_digits(spark):
    df = schedule(spark, {"AverageMonthlyCost": "41.6667", "Monthly Interest Incurred": "0.1234", "Priority": "1"})
    assert [str(v) for v in rows(df, "AverageMonthlyCost", "Monthly Interest Incurred")[0]] == ["41.66670000", "0.12340000"]
    assert rows(occurrences.emergency_fund(df))[0][0] == Decimal("250.0002")
    with pytest.raises(Exception, match="Amount is not in whole cents: 1.005"):
        schedule(spark, {"Amount": "1.005"}).collect()


def test_numbers_may_have_spaces_around_them(spark):
    df = schedule(spark, {"Amount": " -7.5 ", "Limit": " 3", "Priority": "2 ", "Interest Rate": "5 %"})
    assert one(df, "Amount") == m(-7.5) and one(df, "Limit") == m(3)
    assert one(df, "Priority") == 2 and one(df, "Interest Rate") == 0.05


def test_iso_dates_are_read_too(spark):
    assert one(schedule(spark, {"Maturity Date": "2030-01-02"}), "Maturity Date") == D("2030-01-02")


def test_extra_columns_pass_through_the_forecaster_only(spark):
    table = income_expense(spark, {"Type": "monthly"}).selectExpr("*", "'x' AS Note")
    assert one(typed.schedule(table), "Note") == "x"
    assert typed.planner_schedule(table).columns == ["Row_Id", *typed.PLANNER_COLUMNS]


def test_planner_dates(spark):
    df = plan_schedule(spark, {"Start_Date": "3/4/2001", "Maturity Date": ""})
    assert rows(df, "Start_Date", "Maturity_Date") == [(D("2001-03-04"), None)]


def test_details_read_dates_leniently(spark):
    table = text_frame(
        spark,
        schemas.ACCOUNT_DETAILS_TEXT,
        [
            {"Account_Name": "a", "Limit": "", "Interest Rate": "4%", "Maturity Date": "n/a"},
            {"Account_Name": "b", "Limit": "7", "Interest Rate": "", "Maturity Date": "1/2/2003"},
        ],
    )
    assert rows(typed.account_details(table), "Account_Name", "Limit", "Interest Rate", "Maturity Date") == [
        ("a", m(0), 0.04, None),
        ("b", m(7), 0.0, D("2003-01-02")),
    ]


@pytest.mark.parametrize("cell", ["0.000000001", "1.123456789", "-3.0000000010", "1e-9", "12.5E-10"])
def test_digits_beyond_the_eighth_raise(spark, cell):
    df = spark.createDataFrame([(cell,)], "Balance string")
    for read in (cells.exact_money, cells.money, cells.exact_money_or_zero, cells.money_or_zero):
        with pytest.raises(Exception, match="Balance"):
            df.select(read("Balance").alias("b")).collect()


@pytest.mark.parametrize("cell, cents", [("1.10000000000", "1.10"), ("-2", "-2.00"), ("1.5e1", "15.00"), ("25E-2", "0.25"), (" 7.25 ", "7.25")])
def test_zeros_beyond_the_last_digit_are_none(spark, cell, cents):
    df = spark.createDataFrame([(cell,)], "Balance string")
    row = df.select(cells.money("Balance").alias("m"), cells.exact_money("Balance").alias("e")).first()
    assert str(row.m) == cents and row.e == row.m
