"""All cells that cannot be read, found in one pass over the source tables.

The strict readers end a job at the first bad cell. Here each row is marked with its faults while it is laid out in the
shared folder; the faults are counted on the way (``DataFrame.observe``), and the tables are typed from what is laid out. So a
source is scanned once, whether it has faults or not.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cashplan import schemas
from cashplan.functions import cells
from cashplan.operators import typed
from cashplan.operators.occurrences import expected_entries
from cashplan.session import written

#: Row ids shown with each kind of fault.
SAMPLES = 5
CELL_COLUMNS = "`Table` string, Row_Id long, `Column` string, Fault string, Cell string"


def _schedule() -> dict[str, Column]:
    found = {name: cells.exact_money_or_zero_fault(name) for name in ("Balance", "Limit", "Available Credit", "Monthly Interest Incurred")}
    found |= {name: cells.integer_or_zero_fault(name) for name in ("Payoff Order", "Priority")}
    return found | {
        "Amount": cells.money_fault("Amount"),
        "AverageMonthlyCost": cells.exact_money_fault("AverageMonthlyCost"),
        "AfterDays": cells.integer_fault("AfterDays"),
        "Interest Rate": cells.percent_fault("Interest Rate"),
        "Maturity Date": cells.day_fault("Maturity Date"),
    }


def _ledger() -> dict[str, Column]:
    paid = cells.text("Amount_Paid")
    nothing_paid = paid.isNull() | (paid == "") | (paid.try_cast(schemas.MONEY) == 0)
    undated = cells.present("Date").isNull() & nothing_paid
    return {
        "Date": F.coalesce(cells.day_fault("Date"), F.when(undated, F.lit("unpaid without a date"))),
        "Amount": cells.money_fault("Amount"),
        "Amount_Paid": cells.money_or_zero_fault("Amount_Paid"),
        "Running_Balance": cells.exact_money_or_zero_fault("Running_Balance"),
    }


def _balances() -> dict[str, Column]:
    return {"Date": cells.day_fault("Date"), "Balance": cells.exact_money_fault("Balance")}


def _details() -> dict[str, Column]:
    return {"Limit": cells.exact_money_or_zero_fault("Limit"), "Interest Rate": cells.percent_fault("Interest Rate")}


#: For each source table what is wrong with the cells of a column, as text, null where nothing is.
OF_TABLE = {
    schemas.INCOME_EXPENSE: _schedule,
    schemas.ACCOUNT_DATE_BALANCES: _balances,
    schemas.ACCOUNT_DETAILS: _details,
    schemas.TRANSACTIONS_REPORT: _ledger,
}


class BadCells(ValueError):
    """``cells``: every one of them (``Table``, ``Row_Id``, ``Column``, ``Fault``, ``Cell``); ``counts`` by table, column and fault."""

    def __init__(self, cells_: DataFrame, counts: dict[tuple[str, str, str], int], samples: dict[tuple[str, str, str], list[int]]):
        self.cells, self.counts, self.samples = cells_, counts, samples
        lines = (f"{t}.{c} {fault}: {n}, as in rows {samples[t, c, fault]}" for (t, c, fault), n in counts.items())
        super().__init__("cells that cannot be read\n" + "\n".join(lines))


def no_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CELL_COLUMNS)


def marked(table: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """The rows with ``_Faults``, an array of (``Column``, ``Fault``, ``Cell``), empty for most."""
    each = [
        F.struct(F.lit(name).alias("Column"), fault.alias("Fault"), cells.text(name).alias("Cell"))
        for name, fault in faults.items()
    ]
    return table.withColumn("_Faults", F.filter(F.array(*each), lambda one: one["Fault"].isNotNull()))


def repeated_snapshots(table: DataFrame) -> DataFrame:
    """Cells of balances that an account has on a date already; the first row by ``Row_Id`` is none of them.

    The (account, date) groups are counted before they move; only the rows of repeated ones are looked at again.
    """
    day = F.coalesce(F.try_to_date(cells.present("Date"), cells.DAY_FORMAT), cells.present("Date").try_cast("date"))
    rows = table.select("Row_Id", cells.text("Account_Name").alias("_Account"), day.alias("_Day"), cells.text("Balance").alias("Cell"))
    groups = (
        rows.where("_Day IS NOT NULL")
        .groupBy("_Account", "_Day")
        .agg(F.count(F.lit(1)).alias("_Rows"), F.min("Row_Id").alias("_First"))
        .where("_Rows > 1")
    )
    same = rows["_Account"].eqNullSafe(groups["_Account"]) & (rows["_Day"] == groups["_Day"])
    return rows.join(groups, same & (F.col("Row_Id") != F.col("_First"))).select(
        "Row_Id", F.lit("Balance").alias("Column"), F.lit("repeats account and date").alias("Fault"), "Cell"
    )


def due_without_amount(as_of: date, days_back: int, days_forward: int) -> Callable[[DataFrame], DataFrame]:
    """A check of the schedule: rules that are due in the range and have no amount. Rules that are not due may lack one."""

    def check(table: DataFrame) -> DataFrame:
        rules = typed.schedule(table.where((F.size("_Faults") == 0) & cells.text("Amount").isNull()))
        due = expected_entries(rules, as_of, days_back, days_forward).select("Row_Id").distinct()
        return due.select("Row_Id", F.lit("Amount").alias("Column"), F.lit("missing").alias("Fault"), F.lit(None).cast("string").alias("Cell"))

    return check


def checked(
    tables: dict[str, DataFrame], also: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> dict[str, DataFrame]:
    """The source tables (by name, see ``OF_TABLE``), laid out; ``BadCells`` if any of their cells cannot be read.

    ``also`` has checks by table that look at more than a row's own cells, besides ``repeated_snapshots``. ``Row_Id`` must tell
    a table's rows apart. An empty table has no faults; columns that are not named pass through.
    """
    checks = {schemas.ACCOUNT_DATE_BALANCES: repeated_snapshots} | (also or {})
    laid, found = {}, []
    for name, table in tables.items():
        faulty = Observation()
        rows = marked(table, OF_TABLE[name]()).observe(faulty, F.coalesce(F.sum(F.size("_Faults")), F.lit(0)).alias("cells"))
        whole = written(rows)
        if faulty.get["cells"]:
            found.append((name, whole.select("Row_Id", F.inline("_Faults"))))
        laid[name] = whole.drop("_Faults")
        if name in checks:
            more = written(checks[name](whole))
            if not more.isEmpty():
                found.append((name, more))
    if found:
        every = (rows.select(F.lit(name).alias("Table"), F.col("Row_Id").cast("long").alias("Row_Id"), "Column", "Fault", "Cell") for name, rows in found)
        raise _report(written(reduce(DataFrame.unionByName, every)))
    return laid


def _report(rejected: DataFrame) -> BadCells:
    """Counts and some rows of each kind of fault; kinds are bounded by the columns of the tables."""
    kind = ["Table", "Column", "Fault"]
    counts = {tuple(r[:3]): r[3] for r in rejected.groupBy(*kind).count().orderBy(*kind).collect()}
    first = F.row_number().over(Window.partitionBy(*kind).orderBy("Row_Id"))
    samples: dict[tuple[str, str, str], list[int]] = {}
    for r in rejected.withColumn("_Nth", first).where(F.col("_Nth") <= SAMPLES).orderBy(*kind, "Row_Id").collect():
        samples.setdefault((r.Table, r.Column, r.Fault), []).append(r.Row_Id)
    return BadCells(rejected, counts, samples)
