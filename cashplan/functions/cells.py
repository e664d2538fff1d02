"""Typed values out of text cells.

Strict casts rely on Spark's ANSI mode (the default since Spark 4): bad text raises. A blank cell is not a
null: the ``*_or_zero`` readers turn a blank into 0 and leave a true null alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashplan.schemas import EXACT_MONEY, MONEY

# Date formats of the source tables.
DAY_FORMAT = "M/d/yyyy"
DAY_OF_YEAR_FORMAT = "d-MMM"


def text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def present(name: str) -> Column:
    """The cell's text, null when blank."""
    return F.nullif(F.trim(text(name)), F.lit(""))


def _decimal(name: str, kind, digits: int, message: str) -> Column:
    """The cell as a decimal; what has parts beyond its last digit raises, as a cast would round them in silence."""
    cell, shown = F.col(f"`{name}`"), text(name)
    # a power of ten hides the digits, so there the values are compared
    hidden = shown.rlike("[eE]") & (cell.cast("double") != cell.cast(kind).cast("double"))
    finer = shown.rlike(rf"\.\d{{{digits}}}\d*[1-9]") | hidden
    return F.when(finer, F.raise_error(F.concat(F.lit(f"{name} {message}: "), shown))).otherwise(cell.cast(kind))


def money(name: str) -> Column:
    """An amount in whole cents; smaller parts raise, as rounding one amount would put sums out."""
    return _decimal(name, MONEY, 2, "is not in whole cents")


def exact_money(name: str) -> Column:
    """An amount that may have been worked out, to eight digits; more raise."""
    return _decimal(name, EXACT_MONEY, 8, "has more than eight digits")


def exact_money_or_zero(name: str) -> Column:
    return F.when(text(name) == "", F.lit(0).cast(EXACT_MONEY)).otherwise(exact_money(name))


def integer(name: str) -> Column:
    """Whole number; neither blank nor null is allowed."""
    cell = text(name)
    return F.when(cell.isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(cell.cast("int"))


def money_or_zero(name: str) -> Column:
    return F.when(text(name) == "", F.lit(0).cast(MONEY)).otherwise(money(name))


def integer_or_zero(name: str) -> Column:
    cell = text(name)
    return (
        F.when(cell.isNull(), F.raise_error(F.lit(f"{name} is null")))
        .when(cell == "", F.lit(0))
        .otherwise(cell.cast("int"))
    )


def percent(name: str) -> Column:
    """``'12.5%'`` to 0.125, blank to 0."""
    digits = F.replace(text(name), F.lit("%"), F.lit(""))
    return F.when(digits == "", F.lit(0.0)).otherwise(digits.cast("double")) / 100


def _unless_blank(name: str, fault: Column) -> Column:
    return F.when(text(name) == "", F.lit(None).cast("string")).otherwise(fault)


def _decimal_fault(name: str, kind, digits: int) -> Column:
    shown = text(name)
    hidden = shown.rlike("[eE]") & (shown.try_cast("double") != shown.try_cast(kind).cast("double"))
    finer = shown.rlike(rf"\.\d{{{digits}}}\d*[1-9]") | hidden
    return (
        F.when(shown.isNull(), F.lit(None).cast("string"))
        .when(shown.try_cast(kind).isNull(), F.lit("not a number"))
        .when(finer, F.lit("too many digits"))
    )


def money_fault(name: str) -> Column:
    """What :func:`money` would raise for, as text, null where it would not; so the others of this kind."""
    return _decimal_fault(name, MONEY, 2)


def money_or_zero_fault(name: str) -> Column:
    return _unless_blank(name, money_fault(name))


def exact_money_fault(name: str) -> Column:
    return _decimal_fault(name, EXACT_MONEY, 8)


def exact_money_or_zero_fault(name: str) -> Column:
    return _unless_blank(name, exact_money_fault(name))


def integer_fault(name: str) -> Column:
    cell = text(name)
    return F.when(cell.isNull(), F.lit("missing")).when(cell.try_cast("int").isNull(), F.lit("not a whole number"))


def integer_or_zero_fault(name: str) -> Column:
    return _unless_blank(name, integer_fault(name))


def percent_fault(name: str) -> Column:
    digits = F.replace(text(name), F.lit("%"), F.lit(""))
    return F.when((digits != "") & digits.try_cast("double").isNull(), F.lit("not a percentage"))


def day_fault(name: str) -> Column:
    cell = present(name)
    bad = cell.isNotNull() & F.try_to_date(cell, DAY_FORMAT).isNull() & cell.try_cast("date").isNull()
    return F.when(bad, F.lit("not a date"))


def day(name: str) -> Column:
    """Date in ``M/d/yyyy`` or ISO form, null when blank; other text raises."""
    cell = present(name)
    return F.coalesce(F.try_to_date(cell, DAY_FORMAT), cell.cast("date"))


def day_if_valid(name: str) -> Column:
    """Like :func:`day`, but bad text becomes null."""
    cell = present(name)
    return F.coalesce(F.try_to_date(cell, DAY_FORMAT), cell.try_cast("date"))
