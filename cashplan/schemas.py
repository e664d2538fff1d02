"""Table layouts. Every table arrives as text; ``Row_Id`` stands in for the row order of the source."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: For cells that are worked out, as averages and interest are.
EXACT_MONEY = T.DecimalType(28, 8)

# Table names.
INCOME_EXPENSE = "Income_Expense"
ACCOUNT_DATE_BALANCES = "Account_Date_Balances"
ACCOUNT_DETAILS = "Account_Details"
TRANSACTIONS_REPORT = "Transactions_Report"
DAILY_BALANCE_REPORT = "Daily_Balance_Report"
ACCOUNT_BALANCES_REPORT = "Account_Balances_Report"
SUMMARY_ALERTS = "Summary_Alerts"
SUMMARY_LABELS = "Summary_Labels"
MONTHLY_BUDGETS = "Monthly_Budgets"
YEARLY_BUDGETS = "Yearly_Budgets"
ONE_TIME_BUDGETS = "One_Time_Budgets"
BI_WEEKLY_BUDGETS = "Bi_Weekly_Budgets"
TRANSACTIONS = "Transactions"

#: The cells that a job could not read.
REJECTED_CELLS = "Rejected_Cells"

# The kinds of recurring rule, in the order in which a day's occurrences are listed.
ONCELY = "oncely"
YEARLY = "yearly"
MONTHLY = "monthly"
BIWEEKLY = "biweekly"
EVERY_X_DAYS = "everyXDays"
KINDS = [ONCELY, YEARLY, MONTHLY, BIWEEKLY, EVERY_X_DAYS]

# Columns of an expected transaction.
ENTRY_COLUMNS = [
    "Date",
    "Category",
    "Type",
    "Account_Name",
    "Auto_Pay_Account",
    "Amount",
    "Amount_Paid",
    "Date_Paid",
]


def text_table(*names: str) -> T.StructType:
    """A table as it arrives: a row number and text columns."""
    fields = [T.StructField("Row_Id", T.LongType(), False)]
    return T.StructType(fields + [T.StructField(name, T.StringType()) for name in names])


# Columns of the source tables.
INCOME_EXPENSE_TEXT = text_table(
    "Category",
    "Sub_Category",
    "Type",
    "When",
    "Account_Name",
    "Amount",
    "Auto_Pay_Account",
    "Auto_Pay_Amount",
    "AfterDays",
    "AverageMonthlyCost",
    "Balance",
    "Limit",
    "Available Credit",
    "Interest Rate",
    "Monthly Interest Incurred",
    "Payoff Order",
    "Start_Date",
    "Maturity Date",
    "Priority",
)
ACCOUNT_DATE_BALANCES_TEXT = text_table("Date", "Account_Name", "Balance")
ACCOUNT_DETAILS_TEXT = text_table(
    "Account_Name", "Category", "Sub_Category", "Limit", "Interest Rate", "Maturity Date", "Link"
)
TRANSACTIONS_REPORT_TEXT = text_table(*ENTRY_COLUMNS, "Running_Balance")
