from types import SimpleNamespace

import pytest

from cashplan import session
from helpers import rows


def fake(master, warehouse=None, named=None, current=None):
    chosen = [current]
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: chosen[0], setCheckpointDir=lambda path: chosen.__setitem__(0, path)
    )
    settings = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": warehouse}
    conf = SimpleNamespace(get=lambda key, default=None: settings[key])
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_the_clusters_folder_is_used():
    assert session.checkpoint_dir(fake("yarn", current="hdfs:/given")) == "hdfs:/given"
    assert session.checkpoint_dir(fake("yarn", named="hdfs:/named")) == "hdfs:/named"
    assert session.checkpoint_dir(fake("local[4]", named="/named")) == "/named"


def test_without_a_named_folder_it_is_below_the_warehouse():
    assert session.checkpoint_dir(fake("spark://host:7077", "hdfs:/warehouse")).startswith("hdfs:/warehouse")


def test_the_package_is_shipped_once(spark):
    session.ship(spark)
    session.ship(spark)
    assert sum("cashplan.zip" in path for path in spark.sparkContext.listFiles) == 1


def test_written_rows_come_back_typed(spark):
    df = spark.sql("SELECT 1 AS a, DATE '2024-02-29' AS `b c`, CAST(NULL AS DECIMAL(18,2)) AS d")
    back = session.written(df)
    assert back.dtypes == df.dtypes and rows(back) == rows(df)
    assert "cashplan-" in back.inputFiles()[0]


def test_a_warehouse_on_the_drivers_machine_is_no_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake("spark://host:7077", "file:/home/warehouse"))
    assert session.checkpoint_dir(fake("local[2]", "file:/home/warehouse")).startswith("file:/home/warehouse")
