"""The forecaster's recurring rules.

A rule is live strictly before its maturity date; one without a maturity date never occurs, and its start date
is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.functions import cells
from cashplan.functions.dates import expand, on_or_after, spread
from cashplan.schemas import (
    BIWEEKLY,
    ENTRY_COLUMNS,
    EVERY_X_DAYS,
    KINDS,
    MONEY,
    MONTHLY,
    ONCELY,
    YEARLY,
)


def occurrences(rules: DataFrame, first: date, last: date, kinds: Iterable[str] = KINDS) -> DataFrame:
    """Every date in [first, last] on which a typed rule is due: the rule's columns, ``Date``, ``Kind_Rank``.

    All kinds are expanded in one pass over the rules. ``Kind_Rank`` gives the order of kinds within a day.
    """
    range_first = f"DATE '{first}'"
    range_last = f"least(DATE '{last}', date_sub(`Maturity Date`, 1))"
    given_day = f"to_date(`When`, '{cells.DAY_FORMAT}')"
    day_of_year = f"to_date(`When`, '{cells.DAY_OF_YEAR_FORMAT}')"
    day_step = f"CASE Type WHEN '{BIWEEKLY}' THEN 14 WHEN '{EVERY_X_DAYS}' THEN nullif(abs(AfterDays), 0) END"
    month_step = f"CASE Type WHEN '{MONTHLY}' THEN 1 WHEN '{YEARLY}' THEN 12 END"
    start = f"""CASE Type
        WHEN '{ONCELY}' THEN {given_day}
        WHEN '{YEARLY}' THEN make_date({first.year}, month({day_of_year}), 1)
        WHEN '{MONTHLY}' THEN trunc({range_first}, 'month')
        ELSE {on_or_after(range_first, given_day, day_step)} END"""
    day_of_month = f"""CASE Type
        WHEN '{MONTHLY}' THEN CAST(`When` AS INT) WHEN '{YEARLY}' THEN dayofmonth({day_of_year}) END"""

    due = rules.where(
        F.col("Type").isin(list(kinds))
        & (F.col("Maturity Date") > F.lit(first))
        & ((F.col("Type") != EVERY_X_DAYS) | (F.col("AfterDays") != 0))
    )
    dated = expand(
        spread(due) if first < last else due, range_first, range_last, start, day_step, month_step, day_of_month
    )
    ranks = " ".join(f"WHEN '{kind}' THEN {rank}" for rank, kind in enumerate(KINDS, start=1))
    return dated.withColumn("Kind_Rank", F.expr(f"CASE Type {ranks} END")).drop("When")


def occurrences_on(rules: DataFrame, day: date, kinds: Iterable[str] = KINDS) -> DataFrame:
    """The rules due on one day."""
    return occurrences(rules, day, day, kinds)


def expected_entries(rules: DataFrame, as_of: date, days_back: int, days_forward: int) -> DataFrame:
    """Unpaid ledger entries for every occurrence from ``days_back`` before to ``days_forward`` after ``as_of``.

    Besides the entry columns, ``Kind_Rank`` and ``Row_Id`` carry the order of entries within a day.
    """
    due = occurrences(rules, as_of - timedelta(days=days_back), as_of + timedelta(days=days_forward))
    return due.withColumns(
        {"Amount_Paid": F.lit(None).cast(MONEY), "Date_Paid": F.lit(None).cast("string")}
    ).select(*ENTRY_COLUMNS, "Kind_Rank", "Row_Id")


def emergency_fund(rules: DataFrame) -> DataFrame:
    """One row: six months of the average cost of all priority-1 rules."""
    cost = F.sum("AverageMonthlyCost")
    return rules.where(F.col("Priority") == 1).agg(
        (F.coalesce(cost, F.lit(0)) * 6).alias("Emergency_Fund_Amount")
    )
