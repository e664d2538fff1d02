"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; whatever other columns there are, they stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_crc32(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text, which splits documents into those to learn from and those held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def hash01(column: str) -> Column:
    """A pseudo-random number from 0 to 1 that depends on the value alone, to pick a sample by."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(column).cast("string")), F.lit(1 << 31)) / float(1 << 31)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches in small pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def new_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet."""
    while wanted.lower() in {name.lower() for name in df.columns}:
        wanted = f"_{wanted}"
    return wanted


class Cache(dict):
    """A dict that works out what it lacks, and starts anew when it has grown to its limit.

    Strings longer than ``longest`` are worked out each time, so that the limit bounds the bytes kept as well.
    """

    def __init__(self, work_out, limit: int = 200_000, longest: int = 1 << 62):
        super().__init__()
        self.work_out, self.limit, self.longest = work_out, limit, longest

    def keep(self, key, value) -> None:
        if isinstance(key, str) and len(key) > self.longest:
            return
        if len(self) >= self.limit:
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.work_out(key)
        self.keep(key, value)
        return value
