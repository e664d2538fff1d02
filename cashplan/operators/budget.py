"""The planner's recurring rules, laid over a fixed calendar.

A rule is live from its start date through its maturity date, both inclusive; without a maturity date it never
ends, without a start date it never begins. Rules stepping by a number of days other than 14 are not planned.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashplan.functions import cells
from cashplan.functions.dates import expand, on_or_after, spread, with_calendar_parts
from cashplan.operators.numbering import numbered
from cashplan.schemas import BIWEEKLY, MONTHLY, ONCELY, YEARLY

# The planner's calendar.
CALENDAR_START = date(2000, 1, 1)
CALENDAR_END = date(2100, 12, 31)

# The kinds of planned rule, in the order in which equal amounts of a day are listed.
PLAN_KINDS = [MONTHLY, YEARLY, ONCELY, BIWEEKLY]

CALENDAR_COLUMNS = ["Date", "Year", "Month_of_Year", "Day_of_Month", "Day_of_Week"]
_VALIDITY = ["Start_Date", "Maturity_Date", "Amount"]


def calendar(spark: SparkSession, first: date = CALENDAR_START, last: date = CALENDAR_END) -> DataFrame:
    """One row per day in [first, last]."""
    span = spark.range(1).select(F.lit(first).alias("First"), F.lit(last).alias("Last"))
    return calendar_of(span)


def calendar_of(spans: DataFrame) -> DataFrame:
    """One row per day of each span ``First`` .. ``Last``."""
    days = spans.select(F.explode(F.sequence("First", "Last")).alias("Date"))
    return with_calendar_parts(days).select(*CALENDAR_COLUMNS)


def monthly_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("Type") == MONTHLY).select(
        "Type", "Account_Name", F.col("When").cast("int").alias("Day_of_Month"), *_VALIDITY
    )


def yearly_rules(rules: DataFrame) -> DataFrame:
    day = F.to_date("When", cells.DAY_OF_YEAR_FORMAT)
    return rules.where(F.col("Type") == YEARLY).select(
        "Type",
        "Account_Name",
        F.month(day).alias("Month_of_Year"),
        F.dayofmonth(day).alias("Day_of_Month"),
        *_VALIDITY,
    )


def one_time_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("Type") == ONCELY).select(
        "Type", "Account_Name", cells.day("When").alias("Date"), *_VALIDITY
    )


def biweekly_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("Type") == BIWEEKLY).select(
        "Type", "Account_Name", cells.day("When").alias("Occur_Date"), *_VALIDITY
    )


def _biweekly_start(given_day: str) -> str:
    """Every second week is counted from the calendar's first day, or from an earlier given day."""
    return f"CASE WHEN {given_day} IS NOT NULL THEN least({given_day}, DATE '{CALENDAR_START}') END"


def biweekly_occurrences(rules: DataFrame) -> DataFrame:
    """Every fourteenth day of each biweekly rule to the end of the calendar, whether or not the rule is live."""
    every_14_days = f"sequence({_biweekly_start('Occur_Date')}, DATE '{CALENDAR_END}', INTERVAL 14 DAYS)"
    return biweekly_rules(spread(rules)).selectExpr(
        "Type", "Account_Name", f"explode({every_14_days}) AS Date", *_VALIDITY
    )


def planned_budget(
    rules: DataFrame,
    first: date = CALENDAR_START,
    last: date = CALENDAR_END,
    keep_phase: bool = False,
) -> DataFrame:
    """Calendar days within [first, last] with every rule due and live on them.

    ``keep_phase`` counts the fortnights of a rule from its own given day even if that lies after the start of
    the calendar. Rows come unordered; see :func:`in_plan_order`.
    """
    range_first = f"greatest(DATE '{max(first, CALENDAR_START)}', Start_Date)"
    range_last = f"least(DATE '{min(last, CALENDAR_END)}', Maturity_Date)"
    phase = "_given_day" if keep_phase else _biweekly_start("_given_day")
    start = f"""CASE Type
        WHEN '{ONCELY}' THEN _given_day
        WHEN '{YEARLY}' THEN make_date(year({range_first}), month(_day_of_year), 1)
        WHEN '{MONTHLY}' THEN trunc({range_first}, 'month')
        ELSE {on_or_after(range_first, phase, "14")} END"""
    day_of_month = f"""CASE Type
        WHEN '{MONTHLY}' THEN CAST(`When` AS INT) WHEN '{YEARLY}' THEN dayofmonth(_day_of_year) END"""

    live = spread(
        rules.where(
            F.col("Type").isin(ONCELY, YEARLY, MONTHLY, BIWEEKLY)
            & F.col("Start_Date").isNotNull()
            & F.col("Amount").isNotNull()
        )
    ).withColumns(
        {
            "_given_day": F.when(F.col("Type").isin(ONCELY, BIWEEKLY), cells.day("When")),
            "_day_of_year": F.when(F.col("Type") == YEARLY, F.to_date("When", cells.DAY_OF_YEAR_FORMAT)),
        }
    )
    due = expand(
        live,
        first=range_first,
        last=range_last,
        start=start,
        day_step=f"CASE Type WHEN '{BIWEEKLY}' THEN 14 END",
        month_step=f"CASE Type WHEN '{MONTHLY}' THEN 1 WHEN '{YEARLY}' THEN 12 END",
        day_of_month=day_of_month,
    )
    return with_calendar_parts(due).select(*CALENDAR_COLUMNS, "Type", "Account_Name", *_VALIDITY, "Row_Id")


def _plan_order() -> list[Column]:
    kind = F.array_position(F.array(*map(F.lit, PLAN_KINDS)), F.col("Type"))
    return [F.asc_nulls_last("Date"), F.desc_nulls_last("Amount"), kind, F.col("Row_Id")]


def in_plan_order(plan: DataFrame) -> DataFrame:
    """By date, larger amounts first; equal ones by kind, then in the order of the rules."""
    return plan.orderBy(*_plan_order())


def _coarse_plan_order() -> Column:
    """A date and a whole amount in one number, larger amounts first; amounts beyond a billion count as that."""
    most = 10**9
    whole = F.when(F.col("Amount").isNotNull(), F.least(F.greatest("Amount", F.lit(-most)), F.lit(most)).cast("long"))
    after = F.coalesce(F.lit(most) - whole, F.lit((1 << 31) - 1))
    return F.unix_date("Date").cast("long") * F.lit(1 << 31) + after


def with_plan_position(plan: DataFrame) -> DataFrame:
    """The plan with each row's ``Position`` in the order of :func:`in_plan_order`, which survives storing.

    The calendar's parts, which follow from the date, are left out of what is laid out in order.
    """
    parts = [name for name in CALENDAR_COLUMNS if name != "Date"]
    placed = numbered(plan.drop(*parts), *_plan_order(), coarse=_coarse_plan_order())
    return with_calendar_parts(placed).select(*plan.columns, "Position")
