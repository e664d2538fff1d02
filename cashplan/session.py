"""Session set-up shared by the jobs, the benchmark and the tests."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that the cluster names in ``spark.checkpoint.dir``.

    Where no folder is named it is one below ``spark.sql.warehouse.dir``; if that is on the driver's machine, and executors
    are on others, this raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not named and warehouse.startswith(("file:", "/")) and not sc.master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and executors may not share {warehouse}")
        sc.setCheckpointDir(named or f"{warehouse}/cashplan-checkpoints")
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed with the job that asked for it."""
    path = f"{checkpoint_dir(spark)}/cashplan-{uuid.uuid4().hex}"
    if _jobs:
        _jobs[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: its rows stay put, and its lineage ends there.

    Unlike ``DataFrame.checkpoint`` this keeps columns apart, so that readers load the columns they need and
    skip row groups by their statistics.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_jobs: list[list[str]] = []


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Removes the tables of :func:`written` when the job's work is done, or has failed.

    Outside of a job they stay, as a frame that was handed out may still read them; the folder's retention removes
    those.
    """
    _jobs.append([])
    try:
        yield
    finally:
        for path in _jobs.pop():
            remove(spark, path)


def files_of(spark: SparkSession, paths: list[str]) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of change (milliseconds) of the files at the paths, or in those of them that are folders."""
    found = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(target):
            continue
        listed = files.listFiles(target, True)
        while listed.hasNext():
            one = listed.next()
            found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(found))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_zips: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it.

    Not needed where the package is installed on them.
    """
    sc = spark.sparkContext
    if sc.applicationId in _zips:
        return
    _zips[sc.applicationId] = folder = tempfile.TemporaryDirectory()  # until this process ends
    package = Path(__file__).resolve().parent
    archive = Path(folder.name, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
