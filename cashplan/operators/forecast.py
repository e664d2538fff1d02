"""The forecast: ledger and expected entries, one per date and account, with a running balance.

``Source_Rank`` (ledger before expected), ``Kind_Rank`` and ``Row_Id`` make the order of entries total.
"""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashplan.operators.occurrences import expected_entries
from cashplan.schemas import ENTRY_COLUMNS, MONEY, ONCELY
from cashplan.session import written

# Horizon, alert threshold and look-back of the reports.
DAYS_BACK = 5
DAYS_FORWARD = 730
ALERT_THRESHOLD = 1000
ALERT_RECENCY = 1
REPORT_RECENCY = 10
SUMMARY_ROWS = 30

ORDER_KEYS = ["Source_Rank", "Kind_Rank", "Row_Id"]


def entry_order() -> list[Column]:
    """Order within the forecast: by date, expenses before income, then as the entries came."""
    return [F.asc_nulls_last("Date"), F.asc_nulls_last("Amount"), *[F.asc(key) for key in ORDER_KEYS]]


def amount_due() -> Column:
    """What an entry still moves: its amount while it has no payment date, else nothing."""
    open_entry = F.col("Date_Paid").isNull() | (F.col("Date_Paid") == "")
    return F.when(open_entry, F.col("Amount")).otherwise(F.lit(0).cast(MONEY))


def retained(ledger: DataFrame, as_of: date) -> DataFrame:
    """Ledger entries that are paid, or dated before ``as_of``. Missing cells count as 0.

    That includes a missing payment date, which so counts as paid; a blank one does not. An unpaid entry
    without a date has no place in a forecast and raises.
    """
    zero = F.lit(0).cast(MONEY)
    undated = F.raise_error(F.concat(F.lit("no date in unpaid ledger row "), F.col("Row_Id").cast("string")))
    dated = F.when(F.col("Date").isNull(), undated.cast("boolean")).otherwise(F.col("Date") < F.lit(as_of))
    return (
        ledger.withColumns(
            {
                "Amount": F.coalesce("Amount", zero),
                "Amount_Paid": F.coalesce("Amount_Paid", zero),
                "Date_Paid": F.coalesce("Date_Paid", F.lit("0")),
            }
        )
        .where(F.when(F.col("Amount_Paid") != 0, F.lit(True)).otherwise(dated))
        .select(*ENTRY_COLUMNS, "Row_Id")
    )


def with_expected(ledger: DataFrame, expected: DataFrame) -> DataFrame:
    """Ledger entries and expected entries together. An expected entry without an amount raises."""
    missing = F.raise_error(F.concat(F.lit("no amount in rule "), F.col("Row_Id").cast("string")))
    known = ledger.withColumns({"Source_Rank": F.lit(0), "Kind_Rank": F.lit(0)})
    due = expected.withColumns({"Source_Rank": F.lit(1), "Amount": F.coalesce("Amount", missing)})
    return known.unionByName(due)


def keep_first(entries: DataFrame) -> DataFrame:
    """One entry per date and account: the first, the ledger's before any expected one.

    Spark turns ``row_number() = 1`` into a group limit that runs before the shuffle as well, so a pair that
    holds a large share of all rows sends one row per task.
    """
    first = Window.partitionBy("Date", "Account_Name").orderBy(*[F.asc(key) for key in ORDER_KEYS])
    return entries.withColumn("_Rank", F.row_number().over(first)).where(F.col("_Rank") == 1).drop("_Rank")


def entries_to_date(
    ledger: DataFrame,
    rules: DataFrame,
    as_of: date,
    days_back: int = DAYS_BACK,
    days_forward: int = DAYS_FORWARD,
) -> DataFrame:
    """The forecast's entries, without balances."""
    expected = expected_entries(rules, as_of, days_back, days_forward)
    return keep_first(with_expected(retained(ledger, as_of), expected))


def in_order(entries: DataFrame) -> DataFrame:
    """The entries laid out in forecast order over numbered partitions (``Part``), with what each has ``Due``.

    The rows are range-partitioned by the whole order, in which no two are alike, so that even a day or an
    amount that holds most rows is split. A partition number means the same to every reader only while the
    rows stay put: hence they are written to the shared checkpoint folder, which also lets a job survive lost
    executors, and from which all reports on a forecast can read.
    """
    return written(
        entries.withColumn("Due", amount_due())
        .repartitionByRange(*entry_order())
        .withColumn("Part", F.spark_partition_id())
    )


def run_up(ordered: DataFrame, opening: Column | Decimal | int) -> DataFrame:
    """Add ``Running_Balance``, from ``opening`` through each entry in order, and ``Position``, 1, 2, 3, ...

    A prefix sum over all rows, without a task that sees them all: the sums of the partitions, one row each,
    are run up and added to the running sums within them. Each numbered partition gets a task of its own.
    """
    partitions = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("Part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("Part").agg(F.sum("Due").alias("_Sum"), F.count(F.lit(1)).alias("_Rows"))
    offsets = parts.select(
        "Part",
        F.coalesce(F.sum("_Sum").over(before), F.lit(0)).alias("_Sum_Before"),
        F.coalesce(F.sum("_Rows").over(before), F.lit(0)).alias("_Rows_Before"),
    )
    within = Window.partitionBy("Part").orderBy(*entry_order())
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.repartitionById(partitions, F.col("Part"))
        .withColumns({"_Sum": F.sum("Due").over(up_to), "_Rows": F.row_number().over(within)})
        .join(F.broadcast(offsets), "Part")  # one row per partition
        .withColumns(
            {
                "Running_Balance": opening + F.col("_Sum_Before") + F.col("_Sum"),
                "Position": F.col("_Rows_Before") + F.col("_Rows"),
            }
        )
        .drop("Due", "Part", "_Sum", "_Rows", "_Sum_Before", "_Rows_Before")
    )


def running_balance(entries: DataFrame, opening: Column | Decimal | int) -> DataFrame:
    """Entries with their running balance and position."""
    return run_up(in_order(entries), opening)


def forecast(
    ledger: DataFrame,
    rules: DataFrame,
    opening: Column | Decimal | int,
    as_of: date,
    days_back: int = DAYS_BACK,
    days_forward: int = DAYS_FORWARD,
) -> DataFrame:
    """Ledger and expected entries with a running balance."""
    return running_balance(entries_to_date(ledger, rules, as_of, days_back, days_forward), opening)


def label_dates(entries: DataFrame) -> DataFrame:
    """The one-off entries, to label days with."""
    return entries.where(F.col("Type") == ONCELY).select(
        "Date", F.col("Account_Name").alias("Label_Item"), F.col("Amount").alias("Label_Amount")
    )


def ending_daily_balance(entries: DataFrame, opening: Column | Decimal | int) -> DataFrame:
    """Per date, the running balance after its last entry, and ``Label_Count``, its one-off entries.

    A day's closing balance does not depend on the order within the day, so this adds up days, not entries:
    after the aggregation, one row per day is left to run up.
    """
    daily = entries.groupBy("Date").agg(
        F.sum(amount_due()).alias("_Due"), F.count_if(F.col("Type") == ONCELY).alias("Label_Count")
    )
    up_to = Window.orderBy(F.asc_nulls_last("Date")).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "Date", (opening + F.sum("_Due").over(up_to)).alias("Running_Balance"), "Label_Count"
    )


def ending_daily_balance_of(forecast_rows: DataFrame) -> DataFrame:
    """:func:`ending_daily_balance`, read off a forecast that has its running balance already."""
    return forecast_rows.groupBy("Date").agg(
        F.max_by("Running_Balance", "Position").alias("Running_Balance"),
        F.count_if(F.col("Type") == ONCELY).alias("Label_Count"),
    )


def _since(as_of: date, days: int) -> Column:
    return F.col("Date") >= F.lit(as_of - timedelta(days=days))


def alert_dates(
    daily: DataFrame, as_of: date, threshold: float = ALERT_THRESHOLD, recency: int = ALERT_RECENCY
) -> DataFrame:
    """Days from ``recency`` days before ``as_of`` on that end below the threshold."""
    return daily.where(_since(as_of, recency) & (F.col("Running_Balance") < threshold)).select(
        "Date", "Running_Balance"
    )


def daily_balance_report(
    daily: DataFrame,
    labels: DataFrame,
    emergency_fund: DataFrame,
    as_of: date,
    threshold: int = ALERT_THRESHOLD,
    recency: int = REPORT_RECENCY,
) -> DataFrame:
    """Daily balances with their labels, one row per label, and the constant lines of a chart.

    ``daily`` has at most one row per day and is broadcast to the labels, of which one day may hold most; a
    left join would move the labels instead. Days without a label are added from ``daily`` itself.
    """
    days = daily.where(_since(as_of, recency))
    labelled_days = days.where(F.col("Label_Count") > 0)  # the same columns as below, so both share a shuffle
    labelled = labels.where(_since(as_of, recency)).join(F.broadcast(labelled_days), "Date")
    bare = days.where(F.col("Label_Count") == 0).withColumn("Label_Item", F.lit(""))
    rows = labelled.unionByName(bare, allowMissingColumns=True)
    return rows.select(
        F.col("Date").cast("timestamp_ntz").alias("Date"),
        "Running_Balance",
        F.coalesce("Label_Item", F.lit("")).alias("Label_Item"),
        "Label_Amount",
        (-emergency_fund.scalar()).alias("Emergency_Fund_Amount"),
        F.lit(threshold).alias("Alert_Threshold"),
        F.lit(0).alias("Zero"),
    )


def first_alerts(alerts: DataFrame, rows: int = SUMMARY_ROWS) -> DataFrame:
    return alerts.orderBy("Date").limit(rows)


def first_labels(entries: DataFrame, rows: int = SUMMARY_ROWS) -> DataFrame:
    """The first one-off entries in forecast order."""
    return label_dates(entries.where(F.col("Type") == ONCELY).orderBy(*entry_order()).limit(rows))
