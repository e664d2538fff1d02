"""The queries registered for checking: each operator over whole tables, none of them cut down."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashplan.functions import cells
from cashplan.functions.date_formats import with_inferred_dates
from cashplan.operators import as_of, balances, bank, budget, faults, forecast, ladder, occurrences, stored_plan, typed
from cashplan.plans import views
from cashplan.plans.publish import publish_rules
from cashplan.schemas import (
    BI_WEEKLY_BUDGETS,
    BIWEEKLY,
    EVERY_X_DAYS,
    INCOME_EXPENSE,
    KINDS,
    MONTHLY,
    MONTHLY_BUDGETS,
    ONCELY,
    ONE_TIME_BUDGETS,
    TRANSACTIONS_REPORT,
    YEARLY,
    YEARLY_BUDGETS,
)
from cashplan.session import fresh_path, written
from cashplan.sources.bank_exports import parsed, read_exports
from cashplan.sources.tables import TableStore

AS_OF = date(1999, 1, 1)
OPENING_ACCOUNT = "acct_3"
ALERT_THRESHOLD = -12_000_000
WINDOW = date(2000, 10, 1), date(2000, 10, 31)
FIRST_DAY = AS_OF - timedelta(days=forecast.DAYS_BACK)
LAST_DAY = AS_OF + timedelta(days=forecast.DAYS_FORWARD)

Query = Callable[[SparkSession, str], DataFrame]


def _occurrence_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "Row_Id", "Date", "Kind_Rank", "Type", "Category", "Account_Name", "Auto_Pay_Account", "Amount"
    )


def _occurrences(*kinds: str) -> Query:
    return lambda spark, sf: _occurrence_columns(
        occurrences.occurrences(views.schedule(spark, sf), FIRST_DAY, LAST_DAY, kinds)
    )


def _occ_for_date(spark: SparkSession, sf: str) -> DataFrame:
    return _occurrence_columns(occurrences.occurrences_on(views.schedule(spark, sf), AS_OF, KINDS))


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    return occurrences.expected_entries(
        views.schedule(spark, sf), AS_OF, forecast.DAYS_BACK, forecast.DAYS_FORWARD
    )


def _union(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.with_expected(
        forecast.retained(views.ledger(spark, sf), AS_OF), _expected(spark, sf)
    )


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.entries_to_date(views.ledger(spark, sf), views.schedule(spark, sf), AS_OF)


def _opening(spark: SparkSession, sf: str):
    return balances.current_balance(views.balances(spark, sf), OPENING_ACCOUNT)


def _running_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.ledger(spark, sf).withColumns({"Source_Rank": F.lit(0), "Kind_Rank": F.lit(0)})
    return forecast.running_balance(rows, _opening(spark, sf)).select(
        "Row_Id", "Date", "Amount", "Date_Paid", "Running_Balance", "Position"
    )


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast(
        views.ledger(spark, sf), views.schedule(spark, sf), _opening(spark, sf), AS_OF
    )


def _forecast_from_last(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast of the day, made from the one of the day before by what has changed between them."""
    store, name = TableStore(spark, fresh_path(spark)), "Forecast"
    ledger, rules = views.ledger(spark, sf), views.schedule(spark, sf)
    before = written(forecast.entries_to_date(ledger, rules, AS_OF - timedelta(days=1)))
    ladder.build(store, before, name)
    ladder.update(store, name, *ladder.changes_between(before, written(_entries(spark, sf))))
    return ladder.read(store, name, _opening(spark, sf))


def _plan_on_order_days(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored plan has on the days of large orders."""
    store, name = TableStore(spark, fresh_path(spark)), "Planned_Budget"
    stored_plan.store_plan(store, budget.planned_budget(views.planner_schedule(spark, sf)), name)
    return stored_plan.on_days(store, name, views.large_order_days(spark, sf))


def _daily(spark: SparkSession, sf: str, entries: DataFrame | None = None) -> DataFrame:
    return forecast.ending_daily_balance(entries or _entries(spark, sf), _opening(spark, sf))


def _alerts(spark: SparkSession, sf: str, entries: DataFrame | None = None) -> DataFrame:
    return forecast.alert_dates(_daily(spark, sf, entries), AS_OF, ALERT_THRESHOLD)


def _shared_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries, worked out once for the several parts of a report; only the columns that reports read."""
    columns = ["Date", "Type", "Account_Name", "Amount", "Date_Paid", *forecast.ORDER_KEYS]
    return written(_entries(spark, sf).select(*columns))


def daily_balance_report(spark: SparkSession, sf: str) -> DataFrame:
    entries = _shared_entries(spark, sf)
    return forecast.daily_balance_report(
        _daily(spark, sf, entries),
        forecast.label_dates(entries),
        occurrences.emergency_fund(views.schedule(spark, sf)),
        AS_OF,
    )


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    entries = _shared_entries(spark, sf)
    alerts = forecast.first_alerts(_alerts(spark, sf, entries)).select(
        F.lit("alert").alias("Section"),
        "Date",
        F.lit("").alias("Item"),
        F.col("Running_Balance").alias("Amount"),
    )
    labels = forecast.first_labels(entries).select(
        F.lit("label").alias("Section"),
        "Date",
        F.col("Label_Item").alias("Item"),
        F.col("Label_Amount").alias("Amount"),
    )
    return alerts.unionByName(labels)


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar of the days that the ledger spans."""
    span = views.ledger(spark, sf).agg(F.min("Date").alias("First"), F.max("Date").alias("Last"))
    return budget.calendar_of(span)


def _percent(spark: SparkSession, sf: str) -> DataFrame:
    return views.income_expense(spark, sf).select(
        "Row_Id", cells.percent("Interest Rate").alias("Interest_Rate")
    )


def _plan(view: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: view(views.planner_schedule(spark, sf))


def _detailed(view: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: view(views.balances(spark, sf), views.details(spark, sf))


SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]


def _wide_totals(snapshots: DataFrame, details: DataFrame) -> DataFrame:
    """The wide report's totals, of known names: the test tables have five categories, and a sixth would raise."""
    names = [f"{balances.TOTAL}_{segment}" for segment in SEGMENTS]
    return balances.wide_report(snapshots, details, columns=[*names, balances.TOTAL], accounts=False)


def _wide_blocks(snapshots: DataFrame, details: DataFrame) -> DataFrame:
    """The blocks of the wide report, their balances as text."""
    cells_laid = written(balances.wide_cells(snapshots, details))
    blocks = balances.wide_blocks(cells_laid, balances.wide_directory(cells_laid))
    shown = F.transform("Balances", lambda balance: balance.cast("decimal(28,2)").cast("string"))
    return blocks.select("Date", "Block", F.array_join(shown, ",").alias("Balances"))


def _exports_read(spark: SparkSession, sf: str) -> DataFrame:
    """Export files, written from the tables and read back; files have names of their own."""
    folder = fresh_path(spark)
    views.write_exports(spark, sf, folder)
    return bank.classified(read_exports(spark, folder)).drop("file_name")


def _rules_published(spark: SparkSession, sf: str) -> DataFrame:
    """What the planner's job writes to a store, read back."""
    store = TableStore(spark, fresh_path(spark))
    store.write(views.income_expense(spark, sf), INCOME_EXPENSE)
    publish_rules(store)
    sections = (
        store.read(name).select(F.lit(name).alias("Section"), "Type", "Account_Name", F.col("Amount").cast("double").alias("Amount"))
        for name in (MONTHLY_BUDGETS, YEARLY_BUDGETS, ONE_TIME_BUDGETS, BI_WEEKLY_BUDGETS)
    )
    return reduce(DataFrame.unionByName, sections)


def _ledger_rejected(spark: SparkSession, sf: str) -> DataFrame:
    try:
        faults.checked({TRANSACTIONS_REPORT: views.faulty_ledger_text(spark, sf)})
    except faults.BadCells as bad:
        return bad.cells
    return faults.no_cells(spark)


def _dates_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return with_inferred_dates(views.dated_text(spark, sf), ["Month_First", "Day_First", "Year_First", "Month_Name"])


_QUERIES: dict[str, Query] = {
    "typed_schedule": lambda s, sf: typed.schedule(views.income_expense(s, sf)),
    "typed_planner_schedule": lambda s, sf: typed.planner_schedule(views.income_expense(s, sf)),
    "typed_balances": lambda s, sf: typed.account_balances(views.balances_text(s, sf)),
    "typed_details": lambda s, sf: typed.account_details(views.details_text(s, sf)),
    "typed_ledger": lambda s, sf: typed.ledger(views.ledger_text(s, sf)),
    "cells_rejected": _ledger_rejected,
    "parse_percent": _percent,
    "ffill": lambda s, sf: balances.forward_filled(views.balances(s, sf)),
    "balances_filled": _detailed(balances.filled_with_details),
    "balances_wide": _detailed(balances.wide_cells),
    "balances_wide_totals": _detailed(_wide_totals),
    "balances_wide_blocks": _detailed(_wide_blocks),
    "balances_by_sub_category": _detailed(balances.by_sub_category),
    "current_balance": lambda s, sf: balances.current_balances(views.balances(s, sf)),
    "balances_as_of": lambda s, sf: as_of.balances_as_of(
        views.balance_questions(s, sf), views.balances(s, sf), row_id="Question"
    ),
    "emergency_fund": lambda s, sf: occurrences.emergency_fund(views.schedule(s, sf)),
    "occ_oncely": _occurrences(ONCELY),
    "occ_yearly": _occurrences(YEARLY),
    "occ_monthly": _occurrences(MONTHLY),
    "occ_biweekly": _occurrences(BIWEEKLY),
    "occ_every_x_days": _occurrences(EVERY_X_DAYS),
    "occ_for_date": _occ_for_date,
    "expected_occurrences": _expected,
    "ledger_retained": lambda s, sf: forecast.retained(views.ledger(s, sf), AS_OF),
    "ledger_union_expected": _union,
    "dedup_keep_first": _entries,
    "running_balance": _running_balance,
    "forecast": _forecast,
    "forecast_from_last": _forecast_from_last,
    "label_dates": lambda s, sf: forecast.label_dates(_entries(s, sf)),
    "ending_daily_balance": lambda s, sf: _daily(s, sf).drop("Label_Count"),
    "alert_dates": _alerts,
    "daily_balance_report": daily_balance_report,
    "summary_top30": _summary,
    "calendar": _calendar,
    "plan_rules_monthly": _plan(budget.monthly_rules),
    "plan_rules_yearly": _plan(budget.yearly_rules),
    "plan_rules_one_time": _plan(budget.one_time_rules),
    "plan_rules_biweekly": _plan(budget.biweekly_rules),
    "plan_biweekly_occurrences": _plan(budget.biweekly_occurrences),
    "planned_budget": _plan(budget.planned_budget),
    "planned_budget_order": _plan(lambda rules: budget.with_plan_position(budget.planned_budget(rules))),
    "planned_budget_window": _plan(lambda rules: budget.planned_budget(rules, *WINDOW)),
    "planned_budget_on_days": _plan_on_order_days,
    "rules_published": _rules_published,
    "typed_dates_inferred": _dates_inferred,
    "exports_read": _exports_read,
    "bank_canonical": lambda s, sf: bank.classified(
        parsed(views.bank_lines(s, sf), [views.CHECKING_HEADER, views.CARD_HEADER])
    ),
    "bank_classified": lambda s, sf: bank.classified(views.bank_transactions(s, sf)),
}


def comparable(df: DataFrame) -> DataFrame:
    """Doubles for money and midnight timestamps for dates: types every client library hands back alike."""
    return typed.recast(df, {T.DecimalType: T.DoubleType(), T.DateType: T.TimestampNTZType()})


def queries() -> dict[str, Query]:
    return {name: (lambda s, sf, run=run: comparable(run(s, sf))) for name, run in _QUERIES.items()}
