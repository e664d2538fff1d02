"""Records of CSV files whose quoted cells may hold line breaks, in files that are read in splits.

A line break belongs to a cell if the quotes before it in its file are odd in number (a doubled quote within a cell counts
two). So a first scan counts, for each split, its lines with an odd number of quotes. A running sum over the splits of a
file, one row each, tells which splits start within quotes, and which line of which earlier split opened them. In the
second scan lines of splits without such quotes are records as they stand; only in the others, lines are looked at in
order, by the task that reads them, and records are laid out once. Only parts of records that go over a split's (or an
Arrow batch's) bounds are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashplan.session import written

_SPLIT = ["path", "start"]


def decoded(file_name: Column) -> Column:
    """Spark reports a file's name with its special characters URL-encoded, all but the plus sign."""
    return F.url_decode(F.replace(file_name, F.lit("+"), F.lit("%2B")))


def lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``value`` of each line, with the ``path`` and ``file_name`` of its file, the ``start`` of its split, and ``nth``, which
    numbers the lines of a split without gaps."""
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            decoded(F.col("_metadata.file_name")).alias("file_name"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )


def _odd() -> Column:
    """1 for a line with an odd number of quotes, else 0."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return F.when(F.contains("value", F.lit('"')), quotes % 2).otherwise(0)


def _states(all_lines: DataFrame) -> DataFrame:
    """How each split starts: ``inside`` quotes (1) or not (0), and the split and line (``open_start``, ``open_at``) that opened
    them; ``odd`` counts its lines with an odd number of quotes. One row a split, numbered (``split``) when written."""
    flagged = all_lines.select(*_SPLIT, "file_name", "nth", _odd().alias("odd"))
    splits = flagged.groupBy(*_SPLIT, "file_name").agg(
        F.min("nth").alias("first"),
        F.sum("odd").alias("odd"),
        F.max(F.when(F.col("odd") == 1, F.col("nth"))).alias("last_odd"),
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    some = F.col("odd") > 0
    return splits.select(
        *_SPLIT,
        "file_name",
        F.monotonically_increasing_id().alias("split"),
        "odd",
        (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"),
        F.last(F.when(some, F.col("start")), ignorenulls=True).over(before).alias("open_start"),
        F.last(F.col("last_odd") - F.col("first"), ignorenulls=True).over(before).alias("open_at"),
    )


def _raise_if_open(states: DataFrame) -> None:
    left_open = states.groupBy("path").agg((F.sum("odd") % 2).alias("open")).where("open = 1").first()
    if left_open is not None:
        raise ValueError(f"a quote in {left_open.path} is never closed")


def _gatherer():
    """A function that workers need not import this package for."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines, which come in the order of their splits, to records; one that goes on beyond a batch or its split stays in parts."""
        here = None
        for batch in batches:
            split, nth, odd = (batch.column(name).to_numpy() for name in ("split", "nth", "odd"))
            bounds = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)] if len(split) else []
            for begin, end in zip(bounds, bounds[1:], strict=False):
                if here != split[begin]:
                    here, first, next_nth = split[begin], nth[begin], nth[begin]
                    inside, home, home_at = (batch.column(name)[begin].as_py() for name in ("inside", "open_start", "open_at"))
                    start = batch.column("start")[begin].as_py()
                if nth[begin] != next_nth or (np.diff(nth[begin:end]) != 1).any():
                    raise ValueError("lines of a split do not come in their order")
                next_nth = nth[end - 1] + 1
                after = (np.cumsum(odd[begin:end], dtype=np.int64) + inside) % 2
                starts = np.flatnonzero(np.concatenate([[inside], after[:-1]]) == 0)
                bounds_of = np.concatenate([[0], starts[starts > 0], [end - begin]])  # of records, and of a first part
                at = nth[begin:end][bounds_of[:-1]] - first
                homes, homes_at = np.full(len(at), start), at.copy()
                whole = np.ones(len(at), bool)
                if inside:
                    homes[0], homes_at[0], whole[0] = home, home_at, False
                inside = int(after[-1])
                whole[-1] &= not inside
                home, home_at = homes[-1], homes_at[-1]
                lines_of = pa.LargeListArray.from_arrays(
                    pa.array(bounds_of, pa.int64()), batch.column("value").slice(begin, end - begin).cast(pa.large_string())
                )
                columns = [pc.binary_join(lines_of, pa.scalar("\n", pa.large_string())).cast(pa.string()), pa.array(np.full(len(at), here))]
                columns += [pa.array(x) for x in (at, homes, homes_at, whole)]
                yield pa.RecordBatch.from_arrays(columns, ["value", "split", "at", "home", "home_at", "whole"])

    return gathered


def _in_broken_splits(all_lines: DataFrame, broken: DataFrame) -> DataFrame:
    """The records of splits with quotes across lines, gathered where they are read; the few that do not end in the batch or
    split that they start in are in parts, each with the place of the line that its record starts in."""
    of_split = F.broadcast(broken.drop("odd", "file_name"))  # one row a split; lines stay where they are, in their order
    placed = all_lines.withColumn("odd", _odd().cast("int")).join(of_split, _SPLIT)
    columns = ["value", "split", "nth", "odd", "inside", "start", "open_start", "open_at"]
    gathered = placed.select(*columns).mapInArrow(
        _gatherer(), "value string, split long, at long, home long, home_at long, whole boolean"
    )
    return written(gathered).join(F.broadcast(broken.select("split", "path", "file_name", "start")), "split")


def records(spark: SparkSession, folder: str, pattern: str = "*.csv", multiline: bool = True) -> DataFrame:
    """The records of all files, blank ones left out: ``value`` (breaks in it are ``\\n``), ``path``, ``file_name``, and
    the record's place, the ``start`` of its split and ``at``, which orders the records of a split.

    A file with a quote that is never closed raises. Without ``multiline`` each line is a record, which saves a scan.
    """
    all_lines = lines(spark, folder, pattern)
    columns = ["path", "file_name", "start"]
    plain = all_lines
    parts = []
    if multiline:
        states = written(_states(all_lines))
        _raise_if_open(states)
        broken = states.where("odd > 0 OR inside = 1")
        if not broken.isEmpty():
            plain = all_lines.join(broken, _SPLIT, "left_anti")
            found = _in_broken_splits(all_lines, broken)
            parts.append(found.where("whole").select("value", *columns, "at"))
            of_one = F.sort_array(F.collect_list(F.struct("start", "at", "value")))
            joined = (
                found.where("NOT whole").groupBy("path", "file_name", "home", "home_at").agg(of_one.alias("lines"))
            )
            parts.append(
                joined.select(
                    F.array_join("lines.value", "\n").alias("value"),
                    "path",
                    "file_name",
                    F.col("home").alias("start"),
                    F.col("home_at").alias("at"),
                )
            )
    out = plain.select("value", *columns, F.col("nth").alias("at"))
    for part in parts:
        out = out.unionByName(part)
    return out.where(F.trim("value") != "")


def headers(all_records: DataFrame) -> DataFrame:
    """``path`` and ``header`` of each file, its first record, laid out in the shared folder.

    The first place of each file comes first, as numbers are aggregated where they are read, and texts are not.
    """
    found = all_records.where("start = 0")
    places = written(found.groupBy("path").agg(F.min("at").alias("at")))
    return written(found.join(F.broadcast(places), ["path", "at"]).select("path", F.col("value").alias("header")))
