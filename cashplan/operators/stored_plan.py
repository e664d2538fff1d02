"""The planned budget kept by month, so that whoever asks for some days reads the months of those days only."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashplan.operators.budget import CALENDAR_END, CALENDAR_START
from cashplan.sources.tables import TableStore

#: The column that the folders of the stored plan are named by: the first day of a row's month.
MONTH = "Plan_Month"


def _month(day: Column) -> Column:
    return F.trunc(day, "month")


def store_plan(store: TableStore, plan: DataFrame, name: str) -> None:
    """Replace the stored plan ``name``.

    Rows are dealt out in ranges of their order by month, day and rule, so that a task writes few months and a month that holds
    most rows is written by several tasks. The calendar has 1,212 months, which bounds the folders.
    """
    by_month = plan.withColumn(MONTH, _month(F.col("Date"))).repartitionByRange(MONTH, "Date", "Row_Id")
    store.write(by_month, name, partition_by=[MONTH])


def stored_window(store: TableStore, name: str, first: date, last: date) -> DataFrame:
    """The stored plan's rows from ``first`` through ``last``; other months are not read."""
    months = F.col(MONTH).between(_month(F.lit(first)), F.lit(last))
    return store.read(name).where(months & F.col("Date").between(F.lit(first), F.lit(last))).drop(MONTH)


def on_days(store: TableStore, name: str, days: DataFrame) -> DataFrame:
    """The stored plan's rows on the days in ``Date`` of ``days``, each row once however often its day is listed.

    The days are known only when the query runs, and so are the months: Spark prunes them by the joined side, which is
    broadcast. After its duplicates are gone it has a row for each day of the calendar at most (36,890).
    """
    in_calendar = F.col("Date").between(F.lit(CALENDAR_START), F.lit(CALENDAR_END))
    asked = days.select(F.col("Date").cast("date").alias("Date")).where(in_calendar).distinct()
    asked = asked.select(_month(F.col("Date")).alias(MONTH), "Date")
    return store.read(name).join(F.broadcast(asked), [MONTH, "Date"], "left_semi").drop(MONTH)
