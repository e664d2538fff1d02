"""Balances of given accounts on given days: an as-of join of questions with snapshots.

Nothing is densified and no account is brought to one task. Snapshots and questions are laid out together in ranges of
(account, date), so that an account, or a day of it, that holds most rows is split; within a range each question takes
the last snapshot before it, and what a range's questions lack is carried over from the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashplan.session import written

_ORDER = ["_Account", "_Day", "_Asks", "_Tie"]


def balances_as_of(questions: DataFrame, balances: DataFrame, row_id: str | None = None) -> DataFrame:
    """The questions (``Account_Name``, ``Date`` and any other columns) with ``Balance_Date`` and ``Balance``, of the account's
    last snapshot on or before the date.

    Both are null where there is none, and where account or date are null. Snapshots without a balance are passed over;
    of an account's snapshots of one date that of the smallest ``Row_Id`` counts. ``row_id`` names a whole number that
    tells questions apart; without it those alike in every column are counted before they move and come back as often.
    """
    clash = {"Balance", "Balance_Date"} & set(questions.columns)
    if clash:
        raise ValueError(f"questions have columns named as results are: {sorted(clash)}")
    if row_id:
        asked, tie, times = questions, F.col(f"`{row_id}`").cast("long"), F.lit(1)
    else:
        columns = [F.col(f"`{name}`") for name in questions.columns]
        asked = questions.groupBy(*columns).agg(F.count(F.lit(1)).alias("_Times"))
        tie, times = F.xxhash64(*columns), F.col("_Times")
    question = F.struct(*(F.col(f"`{name}`") for name in questions.columns))
    known = balances.where("Account_Name IS NOT NULL AND Date IS NOT NULL AND Balance IS NOT NULL").select(
        F.col("Account_Name").alias("_Account"),
        F.col("Date").alias("_Day"),
        F.lit(0).alias("_Asks"),
        (-F.col("Row_Id")).cast("long").alias("_Tie"),
        F.struct("Date", "Balance").alias("_Known"),
    )
    laid = written(
        known.unionByName(
            asked.select(
                F.col("Account_Name").alias("_Account"),
                F.col("Date").alias("_Day"),
                F.lit(1).alias("_Asks"),
                tie.alias("_Tie"),
                question.alias("_Question"),
                times.alias("_Times"),
            ),
            allowMissingColumns=True,
        )
        .repartitionByRange(*_ORDER)
        .withColumn("_Part", F.spark_partition_id())
    )
    within = Window.partitionBy("_Part", "_Account").orderBy("_Day", "_Asks", "_Tie")
    last = F.last("_Known", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    seen = laid.withColumn("_Seen", last).where("_Asks = 1")
    answer = F.coalesce("_Seen", F.when(F.col("_Account") == F.col("_From"), F.col("_Carried")))
    found = seen.join(F.broadcast(_carried(laid)), "_Part").withColumn("_Answer", F.when(F.col("_Day").isNotNull(), answer))
    if not row_id:
        found = found.withColumn("_Nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_Times"))))
    return found.select(
        "_Question.*", F.col("_Answer.Date").alias("Balance_Date"), F.col("_Answer.Balance").alias("Balance")
    )


def _carried(laid: DataFrame) -> DataFrame:
    """For each range the last snapshot of the ranges before it, and whose it is: one row per range."""
    place = F.struct("_Account", "_Day", "_Tie")
    ends = laid.groupBy("_Part").agg(
        F.max_by(F.struct("_Account", "_Known"), F.when(F.col("_Asks") == 0, place)).alias("_End")
    )
    before = Window.orderBy("_Part").rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(F.col("_End._Known").isNotNull(), F.col("_End")), ignorenulls=True).over(before)
    return ends.withColumn("_End", end).select(
        "_Part", F.col("_End._Account").alias("_From"), F.col("_End._Known").alias("_Carried")
    )
