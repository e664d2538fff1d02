"""A forecast that is brought up to date from the last one instead of being worked out anew.

The entries lie in ranges of the forecast's order. Within a range each entry has its running sum and place from the range's
start; a *ladder* of one row a range has the range's sum, its rows and its first key. What an entry's balance is follows from
both: the sums of the ranges before its own are added when the forecast is read. So an entry that comes, goes or changes
has its own range laid out anew, and all later balances move by a constant, without a row of theirs being touched.

A store with a root keeps it as the table ``<name>`` (the ladder, in snapshots) and the folder ``<name>.ranges`` (a folder for each
range of an update, never written twice). The ladder's commit shows an update as a whole; of two updates that began from one
ladder the second fails.
"""

from __future__ import annotations

import time
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashplan.operators.forecast import ORDER_KEYS, amount_due, entry_order
from cashplan.session import files_of, remove, written
from cashplan.sources.tables import TableStore

#: A range is named by the update that laid it out and its part of that.
_RANGE = ["Update", "Part"]
_KEY, _OF, _SUM, _NTH = "_Key", "_Of", "_Sum", "_Nth"
#: Halvings of the search for an entry's range; enough for any number of ranges.
_HALVINGS = 40


def build(store: TableStore, entries: DataFrame, name: str) -> None:
    """Lay out the entries of a forecast (those before its running balance) and replace the ladder ``name``.

    Every entry has an amount, as ``forecast.retained`` and ``forecast.with_expected`` see to.
    """
    before = store.snapshot(name)
    store.write(entries.limit(0), _layout(name))
    store.write(_laid(store, name, entries.withColumns({"Due": amount_due(), _OF: F.lit(0)})), name, after=before)


def update(store: TableStore, name: str, gone: DataFrame, new: DataFrame) -> None:
    """Take the entries ``gone`` out and put the entries ``new`` in.

    A changed entry is gone as it was and new as it is. Entries are told apart by their whole order, in which no two are
    alike; one that is gone already is passed over. Ranges that no change falls into stay as they are. The rows of the others
    are range-partitioned by order again, so a range that has grown, or takes most of the changes, is split into more.
    Without changes nothing is written.
    """
    before = store.snapshot(name)
    ladder = store.read(name)
    marked = gone.withColumn("_Gone", F.lit(True)).unionByName(new.withColumn("_Gone", F.lit(False)))
    changes = written(_placed(marked.withColumn("Due", amount_due()), ladder))
    if changes.isEmpty():
        return
    numbers = ladder.withColumn(_OF, F.row_number().over(Window.orderBy("First_Key")))  # one row a range
    touched = changes.select(_OF).distinct().join(numbers, _OF).select(*_RANGE, _OF, "Rows")
    rows = _rows_of(store, name, touched.select(*_RANGE, _OF, "Rows")).withColumn(_KEY, _key()).drop(_SUM, _NTH)
    left = rows.join(changes.where("_Gone").select(_KEY), _KEY, "left_anti").drop(_KEY, *_RANGE)
    come = changes.where("NOT _Gone").select(*left.columns)
    fresh = _laid(store, name, left.unionByName(come))
    kept = ladder.join(F.broadcast(touched.select(*_RANGE)), _RANGE, "left_anti")
    store.write(kept.unionByName(fresh), name, after=before)


def changes_between(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries ``gone`` and ``new`` that make the one forecast's entries the other's.

    This reads both whole; who knows the changes, as a day's bookings, hands them to :func:`update` as they are.
    """
    after = after.select(*before.columns)
    return before.exceptAll(after), after.exceptAll(before)


def read(store: TableStore, name: str, opening: Column | Decimal | int) -> DataFrame:
    """The forecast: entries with ``Running_Balance`` and ``Position``, as ``forecast.running_balance`` has them.

    Reads the ranges as they lie, without a shuffle or a sort of entries; one row a range is run up.
    """
    earlier = Window.orderBy("First_Key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store.read(name).select(
        *_RANGE,
        "Rows",
        F.coalesce(F.sum("Due").over(earlier), F.lit(0)).alias("_Sum_Before"),
        F.coalesce(F.sum("Rows").over(earlier), F.lit(0)).alias("_Rows_Before"),
    )
    balance = opening + F.col("_Sum_Before") + F.col(_SUM)
    rows = _rows_of(store, name, offsets)
    rows = rows.withColumns({"Running_Balance": balance, "Position": F.col("_Rows_Before") + F.col(_NTH)})
    return rows.drop(*_RANGE, "Due", _SUM, _NTH, "_Sum_Before", "_Rows_Before")


def remove_replaced(store: TableStore, name: str) -> None:
    """Remove the ranges that no snapshot of the ladder has any more, and that are older than snapshots are kept."""
    live = {tuple(row) for at in store.snapshots(name) for row in store.read_at(name, at).select(*_RANGE).collect()}
    newest: dict[str, int] = {}
    for path, _, at in files_of(store.spark, [_folder(store, name)]):
        folder = path.rsplit("/", 1)[0]
        if "/Part=" in folder:
            newest[folder] = max(at, newest.get(folder, 0))
    for folder, at in newest.items():
        update_of, part = (level.split("=", 1)[1] for level in folder.rsplit("/", 2)[1:])
        if (update_of, part) not in live and at / 1000 <= time.time() - 3600 * store.keep_hours:
            remove(store.spark, folder)


def _key() -> Column:
    """An entry's place in the order of ``entry_order`` as one value that compares alike (missing days and amounts last)."""
    parts = [part for name in ("Date", "Amount") for part in (F.col(name).isNull().alias(f"No_{name}"), F.col(name))]
    return F.struct(*parts, *map(F.col, ORDER_KEYS))


def _layout(name: str) -> str:
    return f"{name}.layout"


def _folder(store: TableStore, name: str) -> str:
    return f"{store.root.rstrip('/')}/{name}.ranges"


def _rows_of(store: TableStore, name: str, ranges: DataFrame) -> DataFrame:
    """The entries of the ``ranges`` (``Update``, ``Part``, ``Rows`` and more), with their columns.

    Folders of other ranges are pruned by the joined side: one row a range, so it is broadcast. No range is
    empty; the condition says so, as Spark prunes by sides that have one.
    """
    columns = store.read(_layout(name)).withColumn("Due", amount_due()).schema
    columns = T.StructType(columns.fields).add(_SUM, T.DecimalType(28, 2)).add(_NTH, "long")
    stored = columns.add("Update", "string").add("Part", "string")
    rows = store.spark.read.schema(stored).parquet(_folder(store, name))
    return rows.join(F.broadcast(ranges.where("Rows > 0").drop("Rows")), _RANGE)


def _placed(entries: DataFrame, ladder: DataFrame) -> DataFrame:
    """Entries with their key and the number, from 1, of the range that it falls into: the last one that begins no later, else
    the first. The ranges' first keys are one sorted array, searched by halves."""
    keys = ladder.agg(F.sort_array(F.collect_list("First_Key"))).scalar()
    keyed = entries.withColumns({_KEY: _key(), "_Keys": keys})

    def halve(at: Column, _: Column) -> Column:
        low, high = at["low"], at["high"]
        middle = F.floor((low + high) / 2).cast("int")
        later = F.struct((middle + 1).alias("low"), high.alias("high"))
        earlier = F.struct(low.alias("low"), middle.alias("high"))
        return F.when(low >= high, at).when(F.get("_Keys", middle) <= F.col(_KEY), later).otherwise(earlier)

    whole = F.struct(F.lit(0).alias("low"), F.size("_Keys").alias("high"))
    begun = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), whole, halve)["low"]
    return keyed.withColumn(_OF, F.greatest(F.lit(1), begun)).drop("_Keys")


def _laid(store: TableStore, name: str, rows: DataFrame) -> DataFrame:
    """Write entries (with ``Due``, and the range ``_Of`` that they were in) as ranges of a new update; those ranges' ladder.

    A task's rows from several old ranges become several new ones, as ranges that stay may lie between these.
    """
    part = F.concat_ws("-", F.lit("part"), F.spark_partition_id(), F.col(_OF))
    # a partition's number means the same to all readers only while the rows stay put
    laid = written(rows.repartitionByRange(_OF, *entry_order()).withColumn("Part", part)).drop(_OF)
    within = Window.partitionBy("Part").orderBy(*entry_order())
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumns(
        {_SUM: F.sum("Due").over(up_to).cast("decimal(28,2)"), _NTH: F.row_number().over(within).cast("long")}
    )
    fresh = uuid.uuid4().hex
    folder = f"{_folder(store, name)}/Update={fresh}"
    summed.write.partitionBy("Part").parquet(folder)
    return (
        store.spark.read.schema(summed.schema).parquet(folder)
        .groupBy("Part")
        .agg(F.sum("Due").alias("Due"), F.count(F.lit(1)).alias("Rows"), F.min(_key()).alias("First_Key"))
        .select(F.lit(fresh).alias("Update"), "*")
    )
