"""Calendar parts and the expansion of recurring dates."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_calendar_parts(df: DataFrame) -> DataFrame:
    """Add year, month, day of month and day of week (Monday = 0) of ``Date``."""
    return df.selectExpr(
        "*",
        "year(Date) AS Year",
        "month(Date) AS Month_of_Year",
        "dayofmonth(Date) AS Day_of_Month",
        "weekday(Date) AS Day_of_Week",
    )


def on_or_after(first: str, anchor: str, step: str) -> str:
    """The first date >= ``first`` that lies a whole number of steps before or after ``anchor``, as SQL."""
    return f"date_add({first}, pmod(date_diff({anchor}, {first}), {step}))"


def spread(rules: DataFrame) -> DataFrame:
    """Deal the rules out evenly before they multiply: a file split of rules may hold far more dates."""
    partitions = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rules.repartition(partitions, "Row_Id")


def expand(
    rules: DataFrame, first: str, last: str, start: str, day_step: str, month_step: str, day_of_month: str
) -> DataFrame:
    """One row per rule and date within [first, last], in column ``Date``. The arguments are SQL expressions.

    A rule either steps by days from ``start``, or by months from the first of the month ``start`` and then
    falls on ``day_of_month`` (a month too short for it is skipped), or, with both steps null, falls on
    ``start`` alone. Each row is expanded where it lies: no join, and work in proportion to the output.
    """
    months = "(year(_last) - year(_start)) * 12 + month(_last) - month(_start)"
    return (
        rules.selectExpr(
            "*",
            f"{first} AS _first",
            f"{last} AS _last",
            f"{start} AS _start",
            f"{day_step} AS _day_step",
            f"{month_step} AS _month_step",
            f"{day_of_month} AS _day",
        )
        .selectExpr(
            "*",
            f"""CAST(CASE WHEN _month_step IS NOT NULL THEN ({months}) DIV _month_step
                     WHEN _day_step IS NOT NULL THEN date_diff(_last, _start) DIV _day_step
                     ELSE 0 END AS INT) AS _steps""",
        )
        .selectExpr("*", "explode(CASE WHEN _steps >= 0 THEN sequence(0, _steps) END) AS _slot")
        .selectExpr(
            "*",
            """CASE WHEN _month_step IS NULL THEN date_add(_start, _slot * coalesce(_day_step, 0))
                    ELSE date_add(add_months(_start, _slot * _month_step), _day - 1) END AS Date""",
        )
        .where("Date BETWEEN _first AND _last AND (_day IS NULL OR dayofmonth(Date) = _day)")
        .drop("_first", "_last", "_start", "_day_step", "_month_step", "_day", "_steps", "_slot")
    )
