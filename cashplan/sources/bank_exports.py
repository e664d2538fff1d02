"""Bank transactions from CSV exports whose headers differ from account to account.

Files are read as records (:mod:`cashplan.sources.records`). A file's first record is its header; only the distinct headers
come to the driver, and each record is parsed by its file's header. The number of jobs does not depend on the number of
files or headers.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashplan.operators.bank import CHECKING, CREDIT_CARD
from cashplan.schemas import MONEY
from cashplan.sources.records import decoded, headers, records

# Header names and the columns they become.
CANONICAL_NAMES = {
    "Transaction Date": "transaction_date",
    "Post Date": "post_date",
    "Description": "description",
    "Category": "category",
    "Type": "type",
    "Amount": "amount",
    "Memo": "memo",
    "Details": "details",
    "Posting Date": "post_date",
    "Balance": "balance",
    "Check or Slip #": "check_or_slip_number",
}

# Columns of a bank transaction.
TRANSACTION_COLUMNS = ["account_type", "file_name", "post_date", "description", "type", "amount"]

# Cells that CSV readers for data analysis take for missing.
MISSING_CELLS = [
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Header cells without a name, as they come from a trailing comma.
_UNNAMED = re.compile(r"^(_c\d+|Unnamed.*)$")
_CSV = {"quote": '"', "escape": '"'}


def _reader(spark: SparkSession, multiline: bool):
    return spark.read.options(header=True, multiLine=multiline, **_CSV)


def _canonical(named: list[str], cell, file_name: Column) -> list[Column]:
    """A row's columns under canonical names. Columns without a name are dropped, missing cells are null."""
    cells = {
        CANONICAL_NAMES.get(name, name): F.when(~cell(name).isin(MISSING_CELLS), cell(name))
        for name in named
        if not _UNNAMED.match(name)
    }
    account_type = CHECKING if "Balance" in named else CREDIT_CARD
    columns = {"account_type": F.lit(account_type), "file_name": file_name} | cells
    return [columns.get(name, F.lit(None).cast("string")).alias(name) for name in TRANSACTION_COLUMNS]


def _text_schema(header: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def _as_transactions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount", F.col("amount").cast(MONEY)).select(*TRANSACTION_COLUMNS)


def _names(header: str) -> list[str]:
    """A header line's names; those that are missing or repeated get a name by their place."""
    names = next(csv.reader([header]))
    return [name if name and names.index(name) == i else f"_c{i}" for i, name in enumerate(names)]


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)


def parsed(lines: DataFrame, headers: list[str]) -> DataFrame:
    """Lines (``value``, with the ``header`` and ``file_name`` of their file) to transactions in one shape."""

    names = {f"row{i}": _names(header) for i, header in enumerate(headers)}
    rows = lines.select(
        "file_name",
        *(
            F.when(F.col("header") == header, F.from_csv("value", _ddl(names[row]), _CSV)).alias(row)
            for row, header in zip(names, headers, strict=True)
        ),
    )  # each line is parsed here, once; below, cells are picked

    def of(row: str) -> Column:
        return F.struct(*_canonical(names[row], lambda name: F.col(row)[name], F.col("file_name")))

    one = F.coalesce(*(F.when(F.col(row).isNotNull(), of(row)) for row in names))
    # inline() keeps later filters above the parsing, which they would otherwise repeat for each cell they read
    return _as_transactions(rows.select(F.inline(F.array(one))))


def read_exports(
    spark: SparkSession,
    folder: str,
    year: str | None = None,
    pattern: str = "*.csv",
    multiline: bool = True,
) -> DataFrame:
    """The transactions of all exports in a folder, or in its subfolder for a year, in one shape.

    A file with a balance column is a checking account's, any other a credit card's. ``post_date`` stays text. A file's
    first record is its header; wherever the same record stands again in the file, as in exports that were put one
    after the other, it is taken for the header as well. Cells in quotes may hold line breaks, and files are split all the
    same (see :mod:`cashplan.sources.records`); ``multiline=False`` takes every line for a record and saves a scan.
    """
    folder = f"{folder.rstrip('/')}/{year}" if year else folder
    found = records(spark, folder, pattern, multiline)
    files = headers(found)
    distinct = sorted(row.header for row in files.select("header").distinct().collect())
    if not distinct:
        raise ValueError(f"no export files in {folder}")
    of_file = found.join(files, "path")
    return parsed(of_file.where(F.col("value") != F.col("header")), distinct)


def read_alike_exports(
    spark: SparkSession, folder: str, header: list[str], pattern: str = "*.csv", multiline: bool = False
) -> DataFrame:
    """Like :func:`read_exports`, for a folder of files that all have the given header.

    No file is opened ahead of the scan. A file with another header makes the scan fail.
    """
    reader = _reader(spark, multiline).options(enforceSchema=False, pathGlobFilter=pattern)
    rows = reader.schema(_text_schema(tuple(header))).csv(folder)
    file_name = decoded(F.col("_metadata.file_name"))
    return _as_transactions(rows.select(*_canonical(header, lambda name: F.col(f"`{name}`"), file_name)))
