"""CSV records across lines and splits."""

import csv
import io
import random

import pyarrow as pa
import pytest

from cashplan.sources import bank_exports, records
from helpers import m, rows

CHECKING = "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #"
CARD = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that cells go over their bounds."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_cell_across_splits_in_files_of_two_shapes(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of ""a"" memo" for i in range(40))
    (tmp_path / "card.csv").write_text(
        f"{CARD}\n01/01/2024,01/02/2024,SHOP,Food,Sale,-12.34,\n01/01/2024,01/03/2024,\"{long}\",Food,Sale,-1,\n"
        "01/01/2024,01/04/2024,BOOK,Fun,Sale,-5,\"x\n\"\n"
    )
    (tmp_path / "check.csv").write_text(f"{CHECKING}\nCREDIT,01/02/2024,\"PA\n\nY\",1500.00,ACH,2500.00,\n")
    df = bank_exports.read_exports(spark, str(tmp_path))
    assert rows(df, "file_name", "post_date", "description", "amount") == [
        ("card.csv", "01/02/2024", "SHOP", m(-12.34)),
        ("card.csv", "01/03/2024", long, m(-1)),
        ("card.csv", "01/04/2024", "BOOK", m(-5)),
        ("check.csv", "01/02/2024", "PA\n\nY", m(1500)),
    ]


def test_records_are_those_of_a_plain_reader(spark, tmp_path, small_splits):
    """Random cells with quotes, commas, breaks and blanks, against one reader over each whole file."""
    rng = random.Random(5)
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        made = [["h1", "h2\nof two lines" if name == "c.csv" else "h2"]]
        made += [["".join(rng.choices(['"', ",", "\n", "x", " ", "yz" * 9], k=rng.randint(1, 12))) + "." for _ in "12"] for _ in range(60)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(made)
        (tmp_path / name).write_text(out.getvalue())
        want += [(name, row) for row in made]
    found = records.records(spark, str(tmp_path))
    assert sorted((r.file_name, next(csv.reader([r.value]))) for r in found.collect()) == sorted(want)
    heads = {r.path.rsplit("/", 1)[1]: r.header for r in records.headers(found).collect()}
    assert heads == {"a.csv": "h1,h2", "b.csv": "h1,h2", "c.csv": 'h1,"h2\nof two lines"'}


def test_a_repeated_header_is_a_header_in_every_split(spark, tmp_path, small_splits):
    line = "01/01/2024,01/02/2024,SHOP,Food,Sale,-1,"
    (tmp_path / "card.csv").write_text("\n".join([CARD, line, CARD, *[line] * 30, CARD, line]) + "\n")
    assert bank_exports.read_exports(spark, str(tmp_path)).count() == 32


def test_a_quote_that_is_never_closed_raises(spark, tmp_path):
    (tmp_path / "card.csv").write_text(f"{CARD}\n01/01/2024,01/02/2024,\"SHOP,Food,Sale,-1,\n")
    with pytest.raises(ValueError, match="card.csv is never closed"):
        bank_exports.read_exports(spark, str(tmp_path))
    assert bank_exports.read_exports(spark, str(tmp_path), multiline=False).columns == bank_exports.TRANSACTION_COLUMNS


def test_whole_lines_are_not_moved(spark, tmp_path):
    """Without breaks in cells there is neither a join with splits nor a window over lines."""
    (tmp_path / "card.csv").write_text(f"{CARD}\n01/01/2024,01/02/2024,\"SHOP\",Food,Sale,-1,\n")
    plan = records.records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_jobs_do_not_grow_with_the_headers(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"{CARD},Extra{i}\n01/01/2024,01/02/2024,\"a\nb\",F,Sale,-1,,\n")
        group = f"headers {n}"
        spark.sparkContext.setJobGroup(group, group)
        assert bank_exports.read_exports(spark, str(folder)).count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(2) + 1


def test_records_across_lines_are_gathered_where_they_are_read(spark, tmp_path, monkeypatch):
    """Neither lines nor headers are sorted or moved, but for the parts of records that go over bounds."""
    (tmp_path / "card.csv").write_text(f"{CARD}\n" + "01/01/2024,01/02/2024,\"a\n\nb\",F,Sale,-1,\n" * 50)
    plans, laid = [], records.written

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return laid(df)

    monkeypatch.setattr(records, "written", written)
    found = records.records(spark, str(tmp_path))
    assert found.where("value LIKE '%a\n\nb%'").count() == 50
    assert [r.header for r in records.headers(found).collect()] == [CARD]
    of_lines = [plan for plan in plans if "MapInArrow" in plan]
    assert len(of_lines) == 1 and "Window" not in of_lines[0] and "Exchange hashpartitioning" not in of_lines[0]
    assert not any("SortAggregate" in plan or "min_by" in plan for plan in plans)


def test_records_that_go_over_a_batch_stay_in_parts():
    def batch(values, nth, split, inside):
        n = len(values)
        columns = {"value": values, "nth": range(nth, nth + n), "split": [split] * n, "inside": [inside] * n}
        columns |= {"odd": [v.count('"') % 2 for v in values], "start": [split * 100] * n}
        columns |= {"open_start": [100 if inside else None] * n, "open_at": [3 if inside else None] * n}
        types = {"value": pa.string(), "odd": pa.int32(), "inside": pa.int32()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in columns.items()})

    batches = [batch(["a", 'b"', ""], 7, 1, 0), batch(['c"', 'd"'], 10, 1, 0), batch(["x", 'y"', "z"], 30, 2, 1)]
    found = [tuple(r.values()) for out in records._gatherer()(iter(batches)) for r in out.to_pylist()]
    assert found == [
        ("a", 1, 0, 100, 0, True), ('b"\n', 1, 1, 100, 1, False), ('c"', 1, 3, 100, 1, False), ('d"', 1, 4, 100, 4, False),
        ('x\ny"', 2, 0, 100, 3, False), ("z", 2, 2, 200, 2, True),
    ]
    with pytest.raises(ValueError, match="order"):
        list(records._gatherer()(iter([batch(["a"], 7, 1, 0), batch(["b"], 9, 1, 0)])))
