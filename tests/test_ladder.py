"""A forecast kept as ranges and brought up to date, against one worked out anew."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cashplan.operators import forecast as fc
from cashplan.operators import ladder
from cashplan.sources.tables import TableStore, WriteConflict
from helpers import D, m

ENTRIES = (
    "Date date, Category string, Type string, Account_Name string, Auto_Pay_Account string, Amount decimal(18,2), "
    "Amount_Paid decimal(18,2), Date_Paid string, Row_Id long, Source_Rank int, Kind_Rank int"
)
NAME, OPENING = "Forecast", 100


def entry(nth, day, amount, paid=""):
    date = None if day is None else D("2024-01-01").fromordinal(D("2024-01-01").toordinal() + day)
    return (date, "c", "monthly", f"a{nth}", "bank", m(amount), m(0), paid, nth, nth % 2, nth % 3)


def entries(rng, first, count):
    days = [*range(20), 7, 7, 7, 7, 7, 7, 7, None]  # a day that holds many
    return [
        entry(first + i, rng.choice(days), rng.randrange(-4, 5), rng.choice(["", None, "1/1/2024"]))
        for i in range(count)
    ]


def frame(spark, rows):
    return spark.createDataFrame(list(rows), ENTRIES)


def forecast_of(df):
    return sorted(map(str, df.select("Row_Id", "Date", "Amount", "Running_Balance", "Position").collect()))


def files(root):
    found = Path(root, f"{NAME}.ranges").rglob("*.parquet")
    return {str(path): path.stat().st_mtime_ns for path in found}


@pytest.fixture(autouse=True)
def uncoalesced(spark):
    """Small ranges stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_the_whole_forecast(spark, tmp_path, seed):
    rng = random.Random(seed)
    store, now = TableStore(spark, str(tmp_path)), {row[8]: row for row in entries(rng, 0, 80)}
    ladder.build(store, frame(spark, now.values()), NAME)
    for step in range(1, 4):
        gone = rng.sample(sorted(now), 9 if step < 3 else len(now))  # at last all of them
        new = entries(rng, 1000 * step, 12)
        changed = [(*now[nth][:5], m(77), *now[nth][6:]) for nth in gone[:4]]
        ladder.update(store, NAME, frame(spark, [now[nth] for nth in gone]), frame(spark, new + changed))
        now = {nth: row for nth, row in now.items() if nth not in gone} | {row[8]: row for row in new + changed}
        whole = fc.running_balance(frame(spark, now.values()), OPENING)
        assert forecast_of(ladder.read(store, NAME, OPENING)) == forecast_of(whole)


def test_only_ranges_with_changes_are_written(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = [entry(i, i, i) for i in range(400)]
    ladder.build(store, frame(spark, rows), NAME)
    before, ranges = files(tmp_path), store.read(NAME).count()
    assert ranges == 8
    late = entry(900, 399, 5)
    ladder.update(store, NAME, frame(spark, [rows[395]]), frame(spark, [late]))
    after = files(tmp_path)
    assert before.items() <= after.items()  # nothing rewritten
    kept = store.read(NAME).join(store.read_at(NAME, store.snapshots(NAME)[0]), ["Update", "Part"]).count()
    assert kept == ranges - 1
    # rows of one old range were read and written
    fresh = store.read(NAME).groupBy("Update").agg(F.sum("Rows").alias("Rows")).orderBy("Rows").first()
    assert fresh["Rows"] < 100
    whole = fc.running_balance(frame(spark, rows[:395] + rows[396:] + [late]), OPENING)
    assert forecast_of(ladder.read(store, NAME, OPENING)) == forecast_of(whole)


def test_a_range_that_grows_is_split_and_no_row_is_sorted_to_read(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    ladder.build(store, frame(spark, [entry(i, i, i) for i in range(80)]), NAME)
    many = spark.range(4000).select(
        F.lit(D("2024-01-05")).alias("Date"),
        *(F.lit("x").alias(name) for name in ("Category", "Type", "Account_Name", "Auto_Pay_Account")),
        *(F.lit(1).cast("decimal(18,2)").alias(name) for name in ("Amount", "Amount_Paid")),
        F.lit("").alias("Date_Paid"),
        (F.col("id") + 1000).alias("Row_Id"),
        *(F.lit(0).alias(name) for name in ("Source_Rank", "Kind_Rank")),
    )
    ladder.update(store, NAME, frame(spark, []), many)
    assert store.read(NAME).agg(F.max("Rows")).first()[0] < 1500
    read = ladder.read(store, NAME, OPENING)
    assert read.agg(F.max("Position")).first()[0] == 4080 == read.select("Position").distinct().count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "SortMergeJoin" not in plan


def test_no_changes_no_entries_and_two_updates_at_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    none, one = frame(spark, []), frame(spark, [entry(1, 3, 5)])
    ladder.build(store, none, NAME)
    assert ladder.read(store, NAME, OPENING).count() == 0
    ladder.update(store, NAME, one, none)  # what is not there is passed over
    ladder.update(store, NAME, none, one)
    number = store.snapshot(NAME).number
    ladder.update(store, NAME, none, none)
    assert store.snapshot(NAME).number == number
    assert [tuple(r) for r in ladder.read(store, NAME, OPENING).select("Running_Balance", "Position").collect()] == [(m(105), 1)]

    class Raced(TableStore):
        def write(self, df, name, after=None, partition_by=()):
            ladder.update(TableStore(spark, str(tmp_path)), NAME, none, frame(spark, [entry(7, 9, 2)]))
            super().write(df, name, after, partition_by)

    with pytest.raises(WriteConflict):
        ladder.update(Raced(spark, str(tmp_path)), NAME, one, none)
    assert ladder.read(store, NAME, OPENING).count() == 2


def test_replaced_ranges_go_with_their_snapshots(spark, tmp_path):
    rows = [entry(i, i, i) for i in range(40)]
    for hours, left in ((24.0, True), (0.0, False)):
        store = TableStore(spark, str(tmp_path / str(left)), keep_hours=hours)
        ladder.build(store, frame(spark, rows), NAME)
        before = files(tmp_path / str(left))
        ladder.update(store, NAME, frame(spark, rows[:1]), frame(spark, []))
        ladder.remove_replaced(store, NAME)
        assert (before.keys() <= files(tmp_path / str(left)).keys()) == left
        assert ladder.read(store, NAME, OPENING).count() == 39
