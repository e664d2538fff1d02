"""Named tables, in the catalog or in a folder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashplan.session import files_of, remove, written

ROW_ID = "Row_Id"
_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


#: Hours for which a replaced snapshot stays, for readers that began before.
KEEP_HOURS = 24.0


class WriteConflict(RuntimeError):
    """Another writer replaced the table meanwhile."""


@dataclass(frozen=True)
class Snapshot:
    """A table's state: the number of its last commit (0: a folder as it was found), the folder, and where it was written by
    others, its files. Equal snapshots have equal rows."""

    number: int
    folder: str
    files: tuple = ()


class TableStore:
    """Reads and overwrites tables by name.

    With ``root``, a table is a folder in ``file_format`` (``parquet``, or ``csv`` with a header); without, it is a table of the
    session's catalog. A frame once read is reused as long as the table's snapshot is the same, whoever wrote it;
    ``force_update`` reads it anew all the same. ``persist`` keeps its rows as well, for tables small enough.

    **Snapshots.** A write lays its rows out in a folder of its own and then commits: it creates the next numbered file of
    ``root/name.snapshots``, which names the folder, and which must not exist yet. So a reader sees the rows before or the rows
    after, never a part, and goes on with the snapshot that it began with. Of two writers that began from the same
    snapshot the second one fails with :class:`WriteConflict`, its rows removed; nothing is lost in silence. The folder of
    a replaced snapshot stays for ``keep_hours`` and goes with a later write. The file system must rename onto
    names that are free only, atomically, as HDFS does.

    A folder ``root/name`` that others wrote is read as it is, its files being the snapshot; it is never removed.
    Catalog tables are replaced by Spark; for commits as above they need a format that has them.

    CSV cells may hold commas, doubled quotes and line breaks. That makes each file one task: tables of many
    large files should be Parquet.
    """

    def __init__(
        self, spark: SparkSession, root: str | None = None, file_format: str = "parquet", keep_hours: float = KEEP_HOURS
    ):
        self.spark = spark
        self.root = root
        self.file_format = file_format
        self.keep_hours = keep_hours
        self._kept: dict[str, tuple[Snapshot, DataFrame]] = {}

    def read(
        self, name: str, force_update: bool = False, persist: bool = False, numbered: bool = False
    ) -> DataFrame:
        """The table; ``numbered`` adds ``Row_Id`` where it has none (see :func:`with_row_ids`)."""
        snapshot = self.snapshot(name)
        if force_update or name not in self._kept or self._kept[name][0] != snapshot:
            self.forget(name)
            self._kept[name] = snapshot, self._load(name, snapshot)
        kept = self._kept[name][1]
        if persist:
            kept.persist()
        return kept if not numbered or ROW_ID in kept.columns else with_row_ids(kept)

    def write(
        self, df: DataFrame, name: str, after: Snapshot | None = None, partition_by: Sequence[str] = ()
    ) -> None:
        """Replace the table.

        ``after`` is the snapshot that the rows were made from; if another one has been committed since, the write fails. By
        default it is the one that is there when the write begins. ``partition_by`` names the columns that the table's
        folders are named by, which readers prune by.
        """
        if self.root is None:
            df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)
        else:
            after = after or self.snapshot(name)
            fresh = f"{name}-{uuid.uuid4().hex}"
            writer = df.write.format(self.file_format).partitionBy(*partition_by)
            if self.file_format == "csv":
                writer = writer.options(**{k: v for k, v in _CSV.items() if k != "multiLine"})
            try:
                writer.save(self._path(fresh))
                self._commit(name, after.number + 1, fresh)
            except BaseException:
                remove(self.spark, self._path(fresh))
                raise
            self._remove_old(name)
        self.forget(name)

    def forget(self, name: str) -> None:
        kept = self._kept.pop(name, None)
        if kept is not None:
            kept[1].unpersist()

    def snapshot(self, name: str) -> Snapshot:
        """What the table is now. Lists commits or files, reads no rows."""
        if self.root is None:
            self.spark.catalog.refreshTable(name)  # a list of files of before is of no use
            return Snapshot(0, name, files_of(self.spark, self.spark.read.table(name).inputFiles()))
        last = max(self._commits(name), default=None)
        if last is None:
            return Snapshot(0, name, files_of(self.spark, [self._path(name)]))
        return self._committed(last)

    def snapshots(self, name: str) -> list[Snapshot]:
        """The snapshots of a folder table that are kept, in the order of their commits."""
        return [self._committed(commit) for commit in sorted(self._commits(name))]

    def read_at(self, name: str, snapshot: Snapshot) -> DataFrame:
        """The table as it was at one of its snapshots."""
        return self._load(name, snapshot)

    def _committed(self, commit: tuple[int, str, int]) -> Snapshot:
        return Snapshot(commit[0], self.spark.read.text(commit[1]).first().value)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _commits(self, name: str) -> list[tuple[int, str, int]]:
        """Number, path and time (milliseconds) of the commits that are kept."""
        listed = files_of(self.spark, [self._path(f"{name}.snapshots")])
        numbered = ((path.rsplit("/", 1)[1], path, at) for path, _, at in listed)
        return [(int(file), path, at) for file, path, at in numbered if file.isdigit()]

    def _commit(self, name: str, number: int, folder: str) -> None:
        """Create the commit file, complete, under a name that must be free."""
        hadoop = self.spark._jvm.org.apache.hadoop
        conf = self.spark._jsc.hadoopConfiguration()
        folder_path = hadoop.fs.Path(self._path(f"{name}.snapshots"))
        files = folder_path.getFileSystem(conf)
        files.mkdirs(folder_path)
        fresh, wanted = hadoop.fs.Path(folder_path, f"{folder}.new"), hadoop.fs.Path(folder_path, f"{number:020d}")
        out = files.create(fresh, True)
        out.write(folder.encode())
        out.close()
        unless_there = self.spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 0)
        try:
            hadoop.fs.FileContext.getFileContext(wanted.toUri(), conf).rename(fresh, wanted, unless_there)
        except Py4JJavaError as error:
            files.delete(fresh, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise WriteConflict(f"{name} has been replaced by another writer since it was read") from None
            raise

    def _remove_old(self, name: str) -> None:
        """Remove snapshots that were replaced longer ago than readers may take; a snapshot ends when the next one begins."""
        commits = sorted(self._commits(name))
        for (_, path, _), (_, _, replaced) in zip(commits, commits[1:], strict=False):
            if replaced / 1000 <= time.time() - 3600 * self.keep_hours:
                folder = self.spark.read.text(path).first().value
                remove(self.spark, path)
                remove(self.spark, self._path(folder))

    def _load(self, name: str, snapshot: Snapshot) -> DataFrame:
        if self.root is None:
            df = self.spark.read.table(name)
        else:
            options = _CSV if self.file_format == "csv" else {}
            df = self.spark.read.format(self.file_format).options(**options).load(self._path(snapshot.folder))
            if self.file_format == "csv":
                df = df.na.fill("")  # as on a sheet, a cell without text is blank, not missing
        if ROW_ID in df.columns:
            df = df.withColumn(ROW_ID, F.col(ROW_ID).cast("long"))
        return df


def with_row_ids(df: DataFrame) -> DataFrame:
    """Rows of files with their place, 1, 2, 3, ..., as ``Row_Id``: by path, then place in the file.

    Rows are numbered within each split of a file, and what the splits before hold is added, one row per split.
    No task sees more than a split, and the numbers do not depend on how the splits are dealt to tasks. The rows
    are written to the shared folder in between, so that both steps see the same ones.
    """
    placed = written(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_nth"),
        )
    )
    split = ["_path", "_start"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(*split, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*split).orderBy("_nth"))
    numbered = placed.withColumn("_within", within).join(offsets, split)
    return numbered.select((F.col("_before") + F.col("_within")).alias(ROW_ID), *df.columns)
