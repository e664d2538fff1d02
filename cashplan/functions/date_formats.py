"""Dates of columns whose format is not known ahead: the one format that all cells of a column agree on.

Each distinct cell gets a bit for every format that reads it. The bits that all cells of a column have in common are the
formats left. Distinct cells are found with a partial aggregate, so a table is passed once and few of its cells are tried.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats that a column of dates may have.
FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/M/d",
    "yyyyMMdd",
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
)


class DateFormatError(ValueError):
    """A column's cells agree on no format, or on several that read them differently."""


# What the letters of a format stand for in a cell.
_FIELDS = {"yyyy": r"\d{4}", "MMM": r"[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}


def shape(form: str) -> str:
    """A pattern of the cells that a format may read."""
    return "^" + re.sub(r"[A-Za-z]+|[^A-Za-z]", lambda part: _fields(part[0]) if part[0].isalpha() else re.escape(part[0]), form) + "$"


def _fields(letters: str) -> str:
    return "".join(_FIELDS[run[0]] for run in re.finditer(r"(.)\1*", letters))


def bits(cell: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A number with bit i set if format i reads the cell. The parser is asked only where the shape is right, as its refusals
    are dear."""
    reads = (
        F.when(cell.rlike(shape(form)) & F.try_to_date(cell, form).isNotNull(), 1 << i).otherwise(0)
        for i, form in enumerate(formats)
    )
    return reduce(Column.bitwiseOR, reads)


def _cells(df: DataFrame, names: list[str]) -> DataFrame:
    """The distinct cells, trimmed and not blank, with the ``place`` of their column in ``names``."""
    cells = (F.struct(F.lit(i).alias("place"), F.trim(F.col(f"`{n}`").cast("string")).alias("cell")) for i, n in enumerate(names))
    return df.select(F.inline(F.array(*cells))).where("cell <> ''").distinct()


def inferred_formats(
    df: DataFrame, names: list[str], prefer: tuple[str, ...] = (), formats: tuple[str, ...] = FORMATS
) -> dict[str, str | None]:
    """The format of each of the columns; None for a column of blanks.

    Where several formats are left, the first of ``prefer`` among them is taken; without one, the column raises if any cell
    means two dates, and its first format left is as good as the others if none does. Cells without a format in common
    raise. Errors name the column and cells. What reaches the driver is a row for each set of formats that cells have.
    """
    cells = _cells(df, names)
    found = cells.withColumn("bits", bits(F.col("cell"), formats)).groupBy("place", "bits").agg(F.min("cell").alias("cell"))
    by_column: dict[int, list] = {}
    for row in found.collect():
        by_column.setdefault(row.place, []).append(row)
    out: dict[str, str | None] = dict.fromkeys(names)
    doubtful = {}
    for place, rows in by_column.items():
        left = reduce(int.__and__, (row.bits for row in rows))
        of = [form for i, form in enumerate(formats) if left >> i & 1]
        if not of:
            raise DateFormatError(f"{names[place]}: {_examples(rows, formats)}")
        preferred = [form for form in prefer if form in of]
        out[names[place]] = (preferred or of)[0]
        if len(of) > 1 and not preferred:
            doubtful[place] = of
    for place, of in doubtful.items():
        dates = F.array_distinct(F.array(*(F.to_date("cell", form) for form in of)))
        unsure = cells.where(F.col("place") == place).where(F.size(dates) > 1).select(F.min("cell").alias("cell")).first()
        if unsure.cell is not None:
            raise DateFormatError(f"{names[place]}: {unsure.cell!r} is a date as {' and as '.join(of)}")
    return out


def _examples(rows: list, formats: tuple[str, ...]) -> str:
    none = [row.cell for row in rows if not row.bits]
    if none:
        return f"{min(none)!r} is in no known format"
    shown = (f"{row.cell!r} ({', '.join(f for i, f in enumerate(formats) if row.bits >> i & 1)})" for row in sorted(rows, key=lambda r: r.cell))
    return f"no format reads all of {', '.join(shown)}"


def with_inferred_dates(
    df: DataFrame, names: list[str], prefer: tuple[str, ...] = (), formats: tuple[str, ...] = FORMATS
) -> DataFrame:
    """The frame with the columns as dates by :func:`inferred_formats`; blank cells are null. Runs a job when called."""
    found = inferred_formats(df, names, prefer, formats)

    def day(name: str) -> Column:
        cell = F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))
        return F.to_date(cell, found[name]) if found[name] else cell.cast("date")

    return df.withColumns({name: day(name) for name in names})
