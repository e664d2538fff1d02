"""Bank transactions, once the exports are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKING = "checking"
CREDIT_CARD = "credit_card"


def classified(transactions: DataFrame) -> DataFrame:
    """Drop checking outflows and card payments, and tell income from expense.

    A missing amount is neither inflow nor outflow: it is kept, as an expense.
    """
    account, amount = F.col("account_type"), F.col("amount")
    outflow = (account == CHECKING) & (amount < 0)
    payment = (account == CREDIT_CARD) & (amount > 0)
    return transactions.where(~F.coalesce(outflow | payment, F.lit(False))).withColumn(
        "income_or_expense", F.when(amount > 0, "income").otherwise("expense")
    )
