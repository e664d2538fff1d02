from datetime import datetime
from pathlib import Path

import pytest

from cashplan import schemas, session
from cashplan.operators import typed
from cashplan.plans import publish
from cashplan.sources.tables import TableStore, WriteConflict
from helpers import D, income_expense, m, rows, text_frame

AS_OF = D("2024-01-10")


@pytest.fixture(params=["parquet", "csv"])
def store(spark, tmp_path, request):
    made = TableStore(spark, str(tmp_path), request.param)
    made.write(
        income_expense(
            spark,
            {"Type": "everyXDays", "When": "1/10/2024", "AfterDays": "10", "Account_Name": "Food", "Amount": "-20"},
            {"Type": "oncely", "When": "1/20/2024", "Account_Name": "Gift", "Amount": "-15"},
            {"Type": "biweekly", "When": "1/12/2024", "Account_Name": "Wage", "Amount": "300"},
            {"Type": "monthly", "When": "31", "Account_Name": "Rent", "Amount": "-200"},
            {"Type": "yearly", "When": "3-Feb", "Account_Name": "Tax", "Amount": "-9"},
        ),
        schemas.INCOME_EXPENSE,
    )
    made.write(
        text_frame(
            spark,
            schemas.ACCOUNT_DATE_BALANCES_TEXT,
            [
                {"Date": "2024-01-01", "Account_Name": "Bank", "Balance": "90"},
                {"Date": "2024-01-09", "Account_Name": "Bank", "Balance": "100"},
                {"Date": "2024-01-09", "Account_Name": "Card", "Balance": "-50"},
            ],
        ),
        schemas.ACCOUNT_DATE_BALANCES,
    )
    made.write(
        text_frame(
            spark,
            schemas.ACCOUNT_DETAILS_TEXT,
            [{"Account_Name": "Bank", "Category": "Cash", "Sub_Category": "s", "Limit": "", "Interest Rate": ""}],
        ),
        schemas.ACCOUNT_DETAILS,
    )
    paid = {"Amount": "-5", "Amount_Paid": "5", "Date_Paid": "2024-01-08", "Running_Balance": ""}
    made.write(
        text_frame(
            spark,
            schemas.TRANSACTIONS_REPORT_TEXT,
            [{"Date": "2024-01-08", "Type": "monthly", "Account_Name": "Old"} | paid],
        ),
        schemas.TRANSACTIONS_REPORT,
    )
    return made


def test_forecast_job(spark, store):
    publish.publish_forecast(store, AS_OF, "Bank", days_back=2, days_forward=12, threshold=100)
    report = store.read(schemas.TRANSACTIONS_REPORT)
    typed_rows = report.selectExpr(
        "Row_Id", "Account_Name", "CAST(Amount AS DOUBLE) AS Amount", "CAST(Running_Balance AS DOUBLE) AS Balance"
    )
    assert rows(typed_rows) == [
        (1, "Old", -5.0, 100.0),
        (2, "Food", -20.0, 80.0),
        (3, "Wage", 300.0, 380.0),
        (4, "Food", -20.0, 360.0),
        (5, "Gift", -15.0, 345.0),
    ]
    daily = store.read(schemas.DAILY_BALANCE_REPORT)
    assert daily.count() == 4 and daily.where("Label_Item = 'Gift'").count() == 1
    alerts = store.read(schemas.SUMMARY_ALERTS).selectExpr("CAST(Running_Balance AS DOUBLE)")
    assert rows(alerts) == [(80.0,)]
    assert rows(store.read(schemas.SUMMARY_LABELS), "Label_Item") == [("Gift",)]
    wide = store.read(schemas.ACCOUNT_BALANCES_REPORT)
    assert wide.columns == ["Date", "Bank", "Card", "Total_Cash", "Total"]
    last = wide.where("CAST(Date AS DATE) = DATE '2024-01-09'").selectExpr("CAST(Total AS DOUBLE)")
    assert rows(last) == [(150.0,)]


def test_forecast_job_runs_on_its_own_output(spark, store):
    publish.publish_forecast(store, AS_OF, "Bank", 2, 12)
    first = rows(store.read(schemas.TRANSACTIONS_REPORT), "Row_Id", "Account_Name")
    publish.publish_forecast(store, AS_OF, "Bank", 2, 12)
    assert rows(store.read(schemas.TRANSACTIONS_REPORT), "Row_Id", "Account_Name") == first


def test_unknown_opening_account_raises(spark, store):
    with pytest.raises(Exception, match="no balance for account Nobody"):
        publish.publish_forecast(store, AS_OF, "Nobody")


def test_rules_job(spark, store):
    publish.publish_rules(store)
    assert rows(store.read(schemas.MONTHLY_BUDGETS), "Account_Name") == [("Rent",)]
    assert rows(store.read(schemas.YEARLY_BUDGETS), "Account_Name") == [("Tax",)]
    assert rows(store.read(schemas.ONE_TIME_BUDGETS), "Account_Name") == [("Gift",)]
    assert rows(store.read(schemas.BI_WEEKLY_BUDGETS), "Account_Name") == [("Wage",)]


def test_transactions_job(spark, store, tmp_path):
    exports = tmp_path / "exports" / "2024"
    exports.mkdir(parents=True)
    (exports / "card.csv").write_text(
        "Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n01/01/2024,01/02/2024,S,F,Sale,-1,\n"
    )
    publish.publish_transactions(store, str(exports.parent), "2024")
    assert rows(store.read(schemas.TRANSACTIONS), "description", "income_or_expense") == [("S", "expense")]


def test_written_rows_are_read_back(spark, store):
    stamp = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    df = spark.createDataFrame([(i, i + 4, i + 8, stamp) for i in range(1, 5)], "A int, B int, C int, Datetime string")
    store.write(df, "Written")
    back = store.read("Written")
    assert back.count() == 4 and back.columns == ["A", "B", "C", "Datetime"]
    assert {datetime.strptime(str(r.Datetime), "%Y-%m-%d %H:%M:%S") for r in back.collect()} == {
        datetime.strptime(stamp, "%Y-%m-%d %H:%M:%S")
    }


def test_a_table_is_reread_after_a_write_or_on_demand(spark, store):
    store.write(spark.range(2), "Numbers")
    kept = store.read("Numbers")
    assert store.read("Numbers") is kept and store.read("Numbers", force_update=True) is not kept
    store.write(spark.range(5), "Numbers")
    assert store.read("Numbers").count() == 5


def test_blank_cells_of_a_foreign_csv_file(spark, tmp_path):
    table = tmp_path / schemas.ACCOUNT_DETAILS
    table.mkdir()
    (table / "sheet.csv").write_text(
        "Row_Id,Account_Name,Category,Sub_Category,Limit,Interest Rate,Maturity Date,Link\n1,Bank,Cash,,,,,\n"
    )
    df = typed.account_details(TableStore(spark, str(tmp_path), "csv").read(schemas.ACCOUNT_DETAILS))
    assert rows(df, "Row_Id", "Limit", "Interest Rate", "Maturity Date", "Link") == [(1, m(0), 0.0, None, "")]


def plain_csv(root, name, header, *lines):
    (root / name).mkdir(parents=True)
    for i, part in enumerate([lines[:2], lines[2:]]):
        if part:
            (root / name / f"tab{i}.csv").write_text("\n".join([header, *part]) + "\n")


def test_jobs_on_plain_csv_tabs_without_row_numbers(spark, tmp_path):
    rule = "Home,Rent,{},{},{},{},Bank,full,0,10,,,,,,,1/1/2000,12/31/2099,1"
    plain_csv(
        tmp_path,
        schemas.INCOME_EXPENSE,
        ",".join(schemas.INCOME_EXPENSE_TEXT.names[1:]),
        rule.format("oncely", "1/20/2024", '"Say ""hi"", Bob"', "-15"),
        rule.format("oncely", "1/20/2024", '"two\nlines"', "-16"),
        rule.format("oncely", "1/21/2024", "Same", "-17"),
        rule.format("oncely", "1/21/2024", "Same", "-18"),
        rule.format("monthly", "31", "Rent", "-200"),
    )
    plain_csv(tmp_path, schemas.ACCOUNT_DATE_BALANCES, "Date,Account_Name,Balance", "1/9/2024,Bank,100", "1/9/2024,Card,5")
    plain_csv(tmp_path, schemas.ACCOUNT_DETAILS, ",".join(schemas.ACCOUNT_DETAILS_TEXT.names[1:]), "Bank,Cash,s,,,,")
    plain_csv(tmp_path, schemas.TRANSACTIONS_REPORT, ",".join(schemas.TRANSACTIONS_REPORT_TEXT.names[1:]), "1/8/2024,H,monthly,Old,Bank,-5,5,1/8/2024,")
    store = TableStore(spark, str(tmp_path), "csv")
    publish.publish_forecast(store, AS_OF, "Bank", 2, 12)
    found = store.read(schemas.TRANSACTIONS_REPORT).selectExpr("Row_Id", "Account_Name", "CAST(Amount AS DOUBLE) AS Amount")
    want = [(1, "Old", -5.0), (2, "two\nlines", -16.0), (3, 'Say "hi", Bob', -15.0), (4, "Same", -17.0)]
    assert rows(found) == want
    publish.publish_rules(store)
    assert rows(store.read(schemas.MONTHLY_BUDGETS), "Account_Name") == [("Rent",)]


def test_row_numbers_follow_files_and_places(spark, tmp_path):
    for i in range(3):
        plain = tmp_path / "t" / f"part{i}.csv"
        plain.parent.mkdir(exist_ok=True)
        plain.write_text("a\n" + "".join(f"{i}-{j:02}\n" for j in range(20)))
    df = TableStore(spark, str(tmp_path), "csv").read("t", numbered=True)
    assert rows(df) == [(20 * i + j + 1, f"{i}-{j:02}") for i in range(3) for j in range(20)]


def test_a_failed_write_leaves_the_table(spark, store):
    store.write(spark.range(3), "Numbers")
    with pytest.raises(Exception, match="midway"):
        store.write(spark.range(100).selectExpr("if(id = 70, CAST(raise_error('midway') AS BIGINT), id) AS id"), "Numbers")
    assert store.read("Numbers", force_update=True).count() == 3
    store.write(store.read("Numbers").selectExpr("CAST(id AS BIGINT) + 1 AS id"), "Numbers")  # reads what it replaces
    assert rows(store.read("Numbers").selectExpr("CAST(id AS BIGINT)")) == [(1,), (2,), (3,)]


def test_jobs_remove_what_they_lay_out(spark, store):
    folder = Path(session.checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("cashplan-*"))
    publish.publish_forecast(store, AS_OF, "Bank", 2, 12)
    assert set(folder.rglob("cashplan-*")) == before


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS cash LOCATION '{tmp_path}/cash'")
    store = TableStore(spark)
    try:
        store.write(spark.range(3), "cash.Numbers")
        assert store.read("cash.Numbers").count() == 3
        store.write(spark.range(4), "cash.Numbers")
        assert store.read("cash.Numbers").count() == 4
    finally:
        spark.sql("DROP DATABASE cash CASCADE")


def test_a_reader_that_began_before_a_write_finishes(spark, store):
    store.write(spark.range(1000).repartition(4), "Numbers")
    begun = store.read("Numbers").repartition(3)
    store.write(spark.range(5), "Numbers")
    assert begun.count() == 1000 and store.read("Numbers").count() == 5


def test_of_two_writers_one_fails_cleanly(spark, store, tmp_path):
    store.write(spark.range(3), "Numbers")
    other = TableStore(spark, str(tmp_path), store.file_format)
    mine, theirs = store.snapshot("Numbers"), other.snapshot("Numbers")
    other.write(spark.range(7), "Numbers", after=theirs)
    folders = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(WriteConflict, match="Numbers"):
        store.write(spark.range(9), "Numbers", after=mine)
    assert store.read("Numbers").count() == 7
    assert sorted(p.name for p in tmp_path.iterdir()) == folders
    assert [p.name for p in (tmp_path / "Numbers.snapshots").iterdir() if p.suffix == ".new"] == []


def test_writers_at_the_same_time(spark, tmp_path):
    """Each commit has a number of its own, and as many writes come through as there are commits."""
    from concurrent.futures import ThreadPoolExecutor

    stores = [TableStore(spark, str(tmp_path)) for _ in range(4)]
    start = stores[0].snapshot("Numbers")

    def write(i):
        try:
            stores[i].write(spark.range(i + 1), "Numbers", after=start)
            return i + 1
        except WriteConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        written = [n for n in pool.map(write, range(4)) if n]
    assert len(written) == 1 and stores[0].read("Numbers").count() == written[0]


def test_another_stores_write_is_seen(spark, store, tmp_path):
    store.write(spark.range(2), "Numbers")
    kept = store.read("Numbers", persist=True)
    assert store.read("Numbers") is kept and kept.is_cached
    TableStore(spark, str(tmp_path), store.file_format).write(spark.range(6), "Numbers")
    assert store.read("Numbers").count() == 6 and not kept.is_cached


def test_files_that_others_write_are_seen(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "Foreign"))
    store = TableStore(spark, str(tmp_path))
    kept = store.read("Foreign")
    assert kept.count() == 4 and store.read("Foreign") is kept
    spark.range(3).write.mode("append").parquet(str(tmp_path / "Foreign"))
    assert store.read("Foreign").count() == 7
    store.write(store.read("Foreign").limit(1), "Foreign")
    assert store.read("Foreign").count() == 1 and spark.read.parquet(str(tmp_path / "Foreign")).count() == 7


def test_old_snapshots_go_with_later_writes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), keep_hours=0)
    for n in (1, 2, 3):
        store.write(spark.range(n), "Numbers")
    assert len(list(tmp_path.glob("Numbers-*"))) == 1 and store.read("Numbers").count() == 3
    assert store.snapshot("Numbers").number == 3
    kept = TableStore(spark, str(tmp_path))
    kept.write(spark.range(4), "Numbers")
    assert len(list(tmp_path.glob("Numbers-*"))) == 2


def test_catalog_tables_are_read_anew_when_their_files_change(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS cash2 LOCATION '{tmp_path}/cash2'")
    one, other = TableStore(spark), TableStore(spark)
    try:
        one.write(spark.range(3), "cash2.Numbers")
        kept = one.read("cash2.Numbers")
        assert one.read("cash2.Numbers") is kept
        other.write(spark.range(4), "cash2.Numbers")
        assert one.read("cash2.Numbers") is not kept and one.read("cash2.Numbers").count() == 4
    finally:
        spark.sql("DROP DATABASE cash2 CASCADE")
