"""Text tables to typed tables. Columns not named here pass through, so one select types a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cashplan.functions import cells

# The columns the planner keeps.
PLANNER_COLUMNS = [
    "Type",
    "When",
    "Account_Name",
    "Amount",
    "Auto_Pay_Account",
    "Auto_Pay_Amount",
    "Start_Date",
    "Maturity_Date",
]


def _schedule_columns() -> dict:
    as_text = ["Category", "Sub_Category", "Type", "Account_Name", "Auto_Pay_Account", "Auto_Pay_Amount"]
    zero_money = ["Balance", "Limit", "Available Credit", "Monthly Interest Incurred"]
    typed = {name: cells.text(name) for name in as_text}
    typed |= {name: cells.exact_money_or_zero(name) for name in zero_money}
    typed |= {name: cells.integer_or_zero(name) for name in ["Payoff Order", "Priority"]}
    typed |= {"Amount": cells.money("Amount"), "AverageMonthlyCost": cells.exact_money("AverageMonthlyCost")}
    return typed | {
        "AfterDays": cells.integer("AfterDays"),
        "Interest Rate": cells.percent("Interest Rate"),
        "Maturity Date": cells.day("Maturity Date"),
    }


def schedule(income_expense: DataFrame) -> DataFrame:
    """Recurring rules as the forecaster reads them."""
    return income_expense.withColumns(_schedule_columns())


def planner_schedule(income_expense: DataFrame) -> DataFrame:
    """Recurring rules as the planner reads them: a start date, and only the planner's columns."""
    columns = _schedule_columns() | {"Start_Date": cells.day("Start_Date")}
    return (
        income_expense.withColumns(columns)
        .withColumnRenamed("Maturity Date", "Maturity_Date")
        .select("Row_Id", *PLANNER_COLUMNS)
    )


def account_balances(table: DataFrame) -> DataFrame:
    return table.withColumns(
        {
            "Date": cells.day("Date"),
            "Account_Name": cells.text("Account_Name"),
            "Balance": cells.exact_money("Balance"),
        }
    )


def account_details(table: DataFrame) -> DataFrame:
    """An account's category; a maturity date that cannot be read becomes null."""
    as_text = ["Account_Name", "Category", "Sub_Category", "Link"]
    return table.withColumns(
        {name: cells.text(name) for name in as_text}
        | {
            "Limit": cells.exact_money_or_zero("Limit"),
            "Interest Rate": cells.percent("Interest Rate"),
            "Maturity Date": cells.day_if_valid("Maturity Date"),
        }
    )


def ledger(transactions_report: DataFrame) -> DataFrame:
    as_text = ["Account_Name", "Category", "Type", "Auto_Pay_Account", "Date_Paid"]
    return transactions_report.withColumns(
        {name: cells.text(name) for name in as_text}
        | {
            "Date": cells.day("Date"),
            "Amount": cells.money("Amount"),
            "Amount_Paid": cells.money_or_zero("Amount_Paid"),
            "Running_Balance": cells.exact_money_or_zero("Running_Balance"),
        }
    )


def at_edge(df: DataFrame) -> DataFrame:
    """Exact decimals become doubles where results leave the engine."""
    return recast(df, {T.DecimalType: T.DoubleType()})


def recast(df: DataFrame, types: dict[type[T.DataType], T.DataType]) -> DataFrame:
    """Cast every column of one of the given types."""
    fields = [T.StructField(f.name, types.get(type(f.dataType), f.dataType)) for f in df.schema.fields]
    return df.to(T.StructType(fields))
