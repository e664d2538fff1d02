"""The jobs a user runs: read the source tables of a store, compute, write the reports back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan import schemas
from cashplan.operators import balances, bank, budget, faults, forecast, occurrences, typed
from cashplan.sources.bank_exports import read_exports
from cashplan.session import job
from cashplan.sources.tables import TableStore


def transactions_report(rows: DataFrame) -> DataFrame:
    """A forecast as the next run's ledger: its order as ``Row_Id``, and a missing payment date left blank."""
    return rows.withColumns(
        {"Row_Id": F.col("Position"), "Date_Paid": F.coalesce("Date_Paid", F.lit(""))}
    ).select("Row_Id", *schemas.ENTRY_COLUMNS, "Running_Balance")


def publish_forecast(
    store: TableStore,
    as_of: date,
    opening_account: str,
    days_back: int = forecast.DAYS_BACK,
    days_forward: int = forecast.DAYS_FORWARD,
    threshold: int = forecast.ALERT_THRESHOLD,
) -> None:
    """Write the transactions, daily balance and account balance reports and the two summary lists.

    The ledger is source and sink: it is read at one snapshot, and if another writer has replaced it when this job is done, the
    job fails rather than overwrite what that one wrote. Cells that cannot be read end the job before any report is written:
    ``BadCells`` counts all of them, and they stand in the table ``Rejected_Cells``. Reading and writing it is safe because its entries are laid out in the checkpoint folder
    before any report is written; all reports but the account balances are derived from that one copy. What is
    laid out is removed at the end.
    """
    with job(store.spark):
        _publish_forecast(store, as_of, opening_account, days_back, days_forward, threshold)


def _publish_forecast(
    store: TableStore, as_of: date, opening_account: str, days_back: int, days_forward: int, threshold: int
) -> None:
    ledger_read = store.snapshot(schemas.TRANSACTIONS_REPORT)
    read = {name: store.read(name, force_update=True, numbered=True) for name in faults.OF_TABLE}
    try:
        laid = faults.checked(read, {schemas.INCOME_EXPENSE: faults.due_without_amount(as_of, days_back, days_forward)})
    except faults.BadCells as bad:
        store.write(bad.cells, schemas.REJECTED_CELLS)
        raise
    rules = typed.schedule(laid[schemas.INCOME_EXPENSE])
    snapshots = typed.account_balances(laid[schemas.ACCOUNT_DATE_BALANCES])
    details = typed.account_details(laid[schemas.ACCOUNT_DETAILS])
    ledger = typed.ledger(laid[schemas.TRANSACTIONS_REPORT])

    opening = balances.current_balance(snapshots, opening_account)
    entries = forecast.in_order(forecast.entries_to_date(ledger, rules, as_of, days_back, days_forward))
    daily = forecast.ending_daily_balance(entries, opening)
    report = forecast.daily_balance_report(
        daily, forecast.label_dates(entries), occurrences.emergency_fund(rules), as_of, threshold
    )
    alerts = forecast.first_alerts(forecast.alert_dates(daily, as_of, threshold))

    store.write(typed.at_edge(report), schemas.DAILY_BALANCE_REPORT)
    store.write(typed.at_edge(balances.wide_report(snapshots, details)), schemas.ACCOUNT_BALANCES_REPORT)
    store.write(typed.at_edge(alerts), schemas.SUMMARY_ALERTS)
    store.write(typed.at_edge(forecast.first_labels(entries)), schemas.SUMMARY_LABELS)
    store.write(transactions_report(forecast.run_up(entries, opening)), schemas.TRANSACTIONS_REPORT, after=ledger_read)


def publish_rules(store: TableStore, force_update: bool = False) -> None:
    """Write the planner's four views of the rules."""
    with job(store.spark):
        _publish_rules(store, force_update)


def _publish_rules(store: TableStore, force_update: bool) -> None:
    rules = typed.planner_schedule(store.read(schemas.INCOME_EXPENSE, force_update, numbered=True))
    store.write(typed.at_edge(budget.monthly_rules(rules)), schemas.MONTHLY_BUDGETS)
    store.write(typed.at_edge(budget.yearly_rules(rules)), schemas.YEARLY_BUDGETS)
    store.write(typed.at_edge(budget.one_time_rules(rules)), schemas.ONE_TIME_BUDGETS)
    store.write(typed.at_edge(budget.biweekly_rules(rules)), schemas.BI_WEEKLY_BUDGETS)


def publish_transactions(store: TableStore, folder: str, year: str | None = None) -> None:
    """Write the classified transactions of a folder of bank exports, or of one year of it."""
    with job(store.spark):
        transactions = bank.classified(read_exports(store.spark, folder, year))
        store.write(typed.at_edge(transactions), schemas.TRANSACTIONS)
