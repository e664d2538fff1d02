"""Small literal tables, and rows as plain tuples."""

from datetime import date
from decimal import Decimal

from cashplan import schemas
from cashplan.operators import typed

D = date.fromisoformat


def m(value):
    return Decimal(str(value)).quantize(Decimal("0.01"))


def nulls_last(row):
    return tuple((value is None, 0 if value is None else value) for value in row)


def rows(df, *names):
    picked = df.select(*[f"`{n}`" for n in names]) if names else df
    return sorted((tuple(r) for r in picked.collect()), key=nulls_last)


def text_frame(spark, schema, records):
    """Rows of a text table from dicts; Row_Id follows the order given."""
    data = [
        tuple([i] + [record.get(name) for name in schema.names[1:]])
        for i, record in enumerate(records, start=1)
    ]
    return spark.createDataFrame(data, schema)


RULE = {
    "Category": "Home",
    "Sub_Category": "Rent",
    "Amount": "-10.00",
    "Auto_Pay_Account": "Bank",
    "Auto_Pay_Amount": "full",
    "AfterDays": "0",
    "AverageMonthlyCost": "10.00",
    "Balance": "",
    "Limit": "",
    "Available Credit": "",
    "Interest Rate": "",
    "Monthly Interest Incurred": "",
    "Payoff Order": "",
    "Start_Date": "1/1/2000",
    "Maturity Date": "12/31/2099",
    "Priority": "1",
}


def income_expense(spark, *rules):
    return text_frame(spark, schemas.INCOME_EXPENSE_TEXT, [RULE | rule for rule in rules])


def schedule(spark, *rules):
    return typed.schedule(income_expense(spark, *rules))


def plan_schedule(spark, *rules):
    return typed.planner_schedule(income_expense(spark, *rules))


def balances(spark, *records):
    table = text_frame(
        spark,
        schemas.ACCOUNT_DATE_BALANCES_TEXT,
        [dict(zip(["Date", "Account_Name", "Balance"], record)) for record in records],
    )
    return typed.account_balances(table)


def details(spark, *records):
    table = text_frame(
        spark,
        schemas.ACCOUNT_DETAILS_TEXT,
        [
            {"Limit": "", "Interest Rate": "", "Maturity Date": "", "Link": ""}
            | dict(zip(["Account_Name", "Category", "Sub_Category"], record))
            for record in records
        ],
    )
    return typed.account_details(table)


def ledger(spark, *records):
    table = text_frame(
        spark,
        schemas.TRANSACTIONS_REPORT_TEXT,
        [
            {"Category": "Home", "Type": "monthly", "Auto_Pay_Account": "Bank", "Amount_Paid": "", "Date_Paid": ""}
            | {"Running_Balance": ""}
            | record
            for record in records
        ],
    )
    return typed.ledger(table)
