"""Account balances on every date, from sparse snapshots.

Snapshots are unique on (Date, Account_Name). The dates of a result are the dates on which any account has a
snapshot; they are numbered 1..n (``Slot``), and a snapshot holds for the slots up to the account's next one. So
dense results are exploded from each snapshot in place, and totals are running sums of balance *changes*,
which cost one row per snapshot instead of one per account and date.

The sides broadcast here, and the windows without a partition, hold at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashplan.operators.numbering import numbered

TOTAL = "Total"
#: Columns of a block of the wide report.
BLOCK_WIDTH = 1024


def _date_slots(balances: DataFrame) -> DataFrame:
    """One row per distinct date: ``Date``, its number ``Slot`` and ``Slots``, the count of dates."""
    by_date = Window.orderBy("Date")
    everything = by_date.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dates = balances.select("Date").where(F.col("Date").isNotNull()).distinct()
    return dates.select(
        "Date",
        F.row_number().over(by_date).alias("Slot"),
        F.count(F.lit(1)).over(everything).cast("int").alias("Slots"),
    )


def _snapshots(balances: DataFrame) -> DataFrame:
    """Snapshots with the account's filled ``Balance`` and its ``Change`` since the snapshot before.

    A second snapshot of an account on one date raises.
    """
    history = Window.partitionBy("Account_Name").orderBy("Date")
    filled = F.last("Balance", ignorenulls=True)
    repeated = F.lag("Date").over(history) == F.col("Date")
    message = F.concat_ws(" ", F.lit("duplicate balance of"), "Account_Name", F.lit("on"), "Date")
    return (
        balances.where(F.col("Date").isNotNull())
        .select(
            "Date",
            "Account_Name",
            F.when(repeated, F.raise_error(message))
            .otherwise(filled.over(history.rowsBetween(Window.unboundedPreceding, 0)))
            .alias("Balance"),
            filled.over(history.rowsBetween(Window.unboundedPreceding, -1)).alias("_Before"),
        )
        .withColumn("Change", F.coalesce(F.col("Balance") - F.coalesce("_Before", F.lit(0)), F.lit(0)))
        .drop("_Before")
    )


def _with_hold(rows: DataFrame, key: str, slots: DataFrame) -> DataFrame:
    """Add the slots each row holds for: from its own to the one before the key's next row.

    A key's first row also covers the slots before it.
    """
    history = Window.partitionBy(key).orderBy("Date")
    placed = rows.join(F.broadcast(slots), "Date")
    return placed.withColumns(
        {
            "_From": F.when(F.lag("Slot").over(history).isNull(), F.lit(1)).otherwise(F.col("Slot")),
            "_To": F.coalesce(F.lead("Slot").over(history) - 1, F.col("Slots")),
        }
    ).drop("Date", "Slots")


def _unroll(held: DataFrame, slots: DataFrame, before_first: Column) -> DataFrame:
    """One row per held slot, with its ``Date``; ``before_first`` is the balance before a key's first row."""
    days = slots.select("Date", F.col("Slot").alias("_At"))
    return (
        held.withColumn("_At", F.explode(F.sequence("_From", "_To")))
        .withColumn("Balance", F.when(F.col("_At") < F.col("Slot"), before_first).otherwise(F.col("Balance")))
        .join(F.broadcast(days), "_At")
        .drop("_At", "_From", "_To", "Slot")
    )


def _listings(details: DataFrame, *columns: str) -> DataFrame:
    """Accounts with the given columns and how often each is ``Listed``; copies are counted before they move."""
    return details.groupBy("Account_Name", *columns).agg(F.count(F.lit(1)).cast("int").alias("Listed"))


def _running_total(changes: DataFrame) -> DataFrame:
    """Date and the sum of all ``Change`` up to it."""
    up_to = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    daily = changes.groupBy("Date").agg(F.sum("Change").alias("Change"))
    return daily.select("Date", F.sum("Change").over(up_to).alias("Balance"))


def _group_totals(changes: DataFrame, key: str, slots: DataFrame) -> DataFrame:
    """The sum of balances per date and key, on every date, from rows of (Date, key, Change)."""
    up_to = Window.partitionBy(key).orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    daily = changes.groupBy(key, "Date").agg(F.sum("Change").alias("Change"))
    totals = daily.select(key, "Date", F.sum("Change").over(up_to).alias("Balance"))
    held = _with_hold(totals, key, slots)
    return _unroll(held, slots, F.lit(0)).select("Date", key, "Balance")


def _changes(snapshots: DataFrame, members: DataFrame, key: str, total_of: str = "accounts") -> DataFrame:
    """Changes of balance by date and key, among them those of the key ``Total``.

    ``members`` says how often each account is ``Listed`` under a key. Every account counts once towards the
    total, listed or not; with ``total_of="columns"`` each of its listings counts as well.
    """
    by_account = Window.partitionBy("Account_Name").orderBy(key)
    numbered = members.withColumn("_Number", F.row_number().over(by_account))
    listed = snapshots.join(numbered, "Account_Name", "left")
    in_key = F.col("Change") * F.col("Listed")
    in_total = F.when(F.coalesce("_Number", F.lit(1)) == 1, F.col("Change")).otherwise(0)
    if total_of == "columns":
        in_total = in_total + F.coalesce(in_key, F.lit(0))
    both = F.array(
        F.struct(F.col(key), in_key.alias("Change")), F.struct(F.lit(TOTAL).alias(key), in_total.alias("Change"))
    )
    return listed.select("Date", F.inline(both)).where(F.col(key).isNotNull())


def forward_filled(balances: DataFrame) -> DataFrame:
    """Every account on every date with its last known balance; null before its first snapshot."""
    slots = _date_slots(balances)
    held = _with_hold(_snapshots(balances).drop("Change"), "Account_Name", slots)
    return _unroll(held, slots, F.lit(None)).select("Date", "Account_Name", "Balance")


def filled_with_details(balances: DataFrame, details: DataFrame) -> DataFrame:
    """:func:`forward_filled` with each account's category, plus a ``Total`` row per date.

    An account listed twice in the details appears once per listing.
    """
    slots = _date_slots(balances)
    snapshots = _snapshots(balances)
    category = _listings(details, "Category", "Sub_Category")
    held = _with_hold(snapshots.drop("Change"), "Account_Name", slots).join(category, "Account_Name", "left")
    once_per_listing = F.explode(F.sequence(F.lit(1), F.coalesce("Listed", F.lit(1))))
    accounts = _unroll(held, slots, F.lit(None)).withColumn("_Listing", once_per_listing)
    totals = _running_total(snapshots).withColumns(
        {name: F.lit(TOTAL) for name in ["Account_Name", "Category", "Sub_Category"]}
    )
    columns = ["Date", "Account_Name", "Balance", "Category", "Sub_Category"]
    return accounts.select(*columns).unionByName(totals.select(*columns))


def by_sub_category(balances: DataFrame, details: DataFrame) -> DataFrame:
    """Filled balances summed by date and sub-category, with ``Total`` as one more sub-category.

    Accounts without a sub-category count towards the total only.
    """
    members = _listings(details.where(F.col("Sub_Category").isNotNull()), "Sub_Category")
    changes = _changes(_snapshots(balances), members, "Sub_Category")
    return _group_totals(changes, "Sub_Category", _date_slots(balances))


def wide_cells(balances: DataFrame, details: DataFrame, total_of: str = "columns") -> DataFrame:
    """The cells of the wide report: ``Date``, ``Column``, ``Balance`` and the column's place.

    There is a column per account (0 before its first snapshot), per category that one of them is in, and
    ``Total``. Columns are placed by ``Place`` (accounts, categories, total), then ``Seen`` (where the details
    name the category first, be it of an account without balances), then name. ``Total`` adds up all columns,
    so an account with a category counts twice; ``total_of="accounts"`` counts each account once.
    """
    slots = _date_slots(balances)
    snapshots = _snapshots(balances)
    named = details.where(F.col("Category").isNotNull()).withColumn(
        "Column", F.concat(F.lit(f"{TOTAL}_"), "Category")
    )
    first_seen = named.groupBy("Column").agg(F.min("Row_Id").alias("Seen"))
    held = _with_hold(snapshots.drop("Change"), "Account_Name", slots)
    account_cells = _unroll(held, slots, F.lit(0)).select(
        "Date",
        F.col("Account_Name").alias("Column"),
        F.coalesce("Balance", F.lit(0)).alias("Balance"),
        F.lit(0).alias("Place"),
        F.lit(0).cast("long").alias("Seen"),
    )
    changes = _changes(snapshots, _listings(named, "Column"), "Column", total_of)
    total_cells = _group_totals(changes, "Column", slots).join(first_seen, "Column", "left")
    is_total = F.col("Column") == TOTAL
    return account_cells.unionByName(
        total_cells.withColumns(
            {
                "Place": F.when(is_total, 2).otherwise(1),
                "Seen": F.when(is_total, 0).otherwise(F.col("Seen")).cast("long"),
            }
        )
    )


def wide_report(
    balances: DataFrame,
    details: DataFrame,
    total_of: str = "columns",
    columns: list[str] | None = None,
    accounts: bool = True,
) -> DataFrame:
    """One row per date with the columns of :func:`wide_cells`, for a sink that needs them side by side.

    A wide schema must be known ahead: unless ``columns`` names them, a job looks the names up when this is
    called, and the driver holds one name per column. A cell of a column that ``columns`` does not name raises.
    ``accounts=False`` leaves out the columns of single accounts. Balances are doubles here. A report with more columns
    than a row should have is that of :func:`wide_blocks`.
    """
    cells = wide_cells(balances, details, total_of)
    if not accounts:
        cells = cells.where("Place > 0")
    if columns is None:
        places = cells.select("Column", "Place", "Seen").distinct().orderBy("Place", "Seen", "Column")
        columns = [row.Column for row in places.toLocalIterator()]
    else:
        unknown = F.raise_error(F.concat(F.lit("not among the columns of the wide report: "), F.col("Column")))
        known = F.when(F.col("Column").isin(columns), F.col("Column")).otherwise(unknown)
        cells = cells.withColumn("Column", known)
    exact = cells.withColumn("Balance", F.col("Balance").cast("double"))  # summed up already
    return exact.groupBy("Date").pivot("Column", columns).agg(F.sum("Balance"))


def wide_directory(cells: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """``Column``, ``Place`` and ``Seen`` of the wide report's columns, with the ``Block`` and the ``Slot`` (from 0) of each."""
    columns = cells.select("Column", "Place", "Seen").distinct()
    placed = numbered(columns, F.col("Place"), F.col("Seen"), F.col("Column"), name="_Index")
    index = F.col("_Index") - 1
    return placed.withColumns({"Block": F.floor(index / width), "Slot": (index % width).cast("int")}).drop("_Index")


def wide_blocks(cells: DataFrame, directory: DataFrame) -> DataFrame:
    """The wide report in blocks of columns: ``Date``, ``Block`` and ``Balances``, an array by ``Slot``, null where a column has
    no cell on that date.

    No column has a name in the schema, so the report may have any number of them: what a row holds is bounded by the
    directory's width, and no name reaches the driver.
    """
    sizes = directory.groupBy("Block").agg(F.count(F.lit(1)).cast("int").alias("_Size"))
    placed = cells.join(directory.select("Column", "Block", "Slot"), "Column")
    rows = placed.groupBy("Date", "Block").agg(F.map_from_entries(F.collect_list(F.struct("Slot", "Balance"))).alias("_Cells"))
    slots = F.sequence(F.lit(0), F.col("_Size") - 1)
    balances = F.transform(slots, lambda slot: F.element_at(F.col("_Cells"), slot))
    return rows.join(sizes, "Block").select("Date", "Block", balances.alias("Balances"))


def current_balances(balances: DataFrame) -> DataFrame:
    """Each account's balance on its latest date; listed twice on it, the first row counts."""
    order = F.struct("Date", -F.col("Row_Id"))
    return balances.groupBy("Account_Name").agg(
        F.max("Date").alias("Date"), F.max_by("Balance", order).alias("Balance")
    )


def current_balance(balances: DataFrame, account: str) -> Column:
    """One account's balance on its latest date, as a scalar to use in other frames; none at all raises.

    Should the table list the account twice on that date, the first row counts.
    """
    order = F.struct("Date", -F.col("Row_Id"))
    latest = balances.where(F.col("Account_Name") == account).agg(F.max_by("Balance", order))
    return F.coalesce(latest.scalar(), F.raise_error(F.lit(f"no balance for account {account}")))
