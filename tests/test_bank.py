import pytest

from cashplan.operators import bank
from cashplan.sources import bank_exports
from helpers import m, rows

CHECKING = "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #"
CARD = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, lines in files.items():
            (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        return str(tmp_path)

    return write


def test_both_shapes_in_one_folder(spark, folder):
    path = folder(
        check=[CHECKING, "CREDIT,01/02/2024,PAY,1500.00,ACH,2500.00,", "DEBIT,01/03/2024,RENT,-900.50,ACH,1,,"],
        card=[CARD, "01/01/2024,01/02/2024,SHOP,Food,Sale,-12.34,", "01/05/2024,01/06/2024,PAID,,Payment,50,"],
        card2=[CARD, "02/01/2024,02/02/2024,BOOK,Fun,Sale,-5.00,gift"],
    )
    df = bank_exports.read_exports(spark, path)
    assert df.columns == bank_exports.TRANSACTION_COLUMNS
    assert rows(df) == [
        ("checking", "check.csv", "01/02/2024", "PAY", "ACH", m(1500)),
        ("checking", "check.csv", "01/03/2024", "RENT", "ACH", m(-900.5)),
        ("credit_card", "card.csv", "01/02/2024", "SHOP", "Sale", m(-12.34)),
        ("credit_card", "card.csv", "01/06/2024", "PAID", "Payment", m(50)),
        ("credit_card", "card2.csv", "02/02/2024", "BOOK", "Sale", m(-5)),
    ]
    assert rows(bank.classified(df), "description", "income_or_expense") == [
        ("BOOK", "expense"),
        ("PAY", "income"),
        ("SHOP", "expense"),
    ]


def test_trailing_comma_in_header_and_lines(spark, folder):
    path = folder(check=[CHECKING + ",", "CREDIT,01/02/2024,PAY,7.00,ACH,9,12,", "CREDIT,01/03/2024,X,8,ACH,9,12,,"])
    assert rows(bank_exports.read_exports(spark, path), "post_date", "type", "amount") == [
        ("01/02/2024", "ACH", m(7)),
        ("01/03/2024", "ACH", m(8)),
    ]


def test_one_file_with_quotes_and_missing_cells(spark, folder):
    path = folder(card=[CARD, '01/01/2024,01/02/2024,"A, ""B""",NA,Sale,,', "01/01/2024,01/03/2024,N/A,x,Sale,NaN,"])
    df = bank_exports.read_exports(spark, path)
    assert rows(df, "post_date", "description", "amount") == [
        ("01/02/2024", 'A, "B"', None),
        ("01/03/2024", None, None),
    ]
    assert rows(bank.classified(df), "income_or_expense") == [("expense",), ("expense",)]


def test_line_breaks_within_quotes(spark, folder):
    path = folder(card=[CARD, '01/01/2024,01/02/2024,"two', 'lines",Food,Sale,-1,'])
    df = bank_exports.read_exports(spark, path, multiline=True)
    assert rows(df, "description", "amount") == [("two\nlines", m(-1))]


def test_bad_amount_and_empty_folder_raise(spark, folder):
    path = folder(card=[CARD, "01/01/2024,01/02/2024,SHOP,Food,Sale,a lot,"])
    with pytest.raises(Exception):
        bank_exports.read_exports(spark, path).collect()
    with pytest.raises(ValueError):
        bank_exports.read_exports(spark, path, pattern="*.txt")


def test_line_breaks_in_files_of_two_shapes(spark, folder):
    path = folder(
        card=[CARD, '01/01/2024,01/02/2024,"two', 'lines",Food,Sale,-1,'],
        check=[CHECKING, "CREDIT,01/02/2024,PAY,1500.00,ACH,2500.00,"],
    )
    df = bank_exports.read_exports(spark, path, multiline=True)
    assert rows(df, "account_type", "file_name", "description", "amount") == [
        ("checking", "check.csv", "PAY", m(1500)),
        ("credit_card", "card.csv", "two\nlines", m(-1)),
    ]


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(n):
        path = tmp_path / str(n)
        path.mkdir()
        for i in range(n):
            header, line = (CARD, "1/1/2024,1/2/2024,S,F,Sale,-1,") if i % 2 else (CHECKING, "CREDIT,1/2/2024,P,5,ACH,9,")
            (path / f"f{i}.csv").write_text(f"{header}\n{line}\n")
        group = f"read {n}"
        spark.sparkContext.setJobGroup(group, group)
        assert bank_exports.read_exports(spark, str(path)).count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = jobs(4)
    assert jobs(1000) <= few + 3  # reading very many small files, Spark lists them in a job


def test_zero_is_an_expense_and_nulls_survive(spark):
    df = spark.createDataFrame(
        [("checking", 0), ("checking", None), ("checking", -1), ("credit_card", 0), ("credit_card", None)]
        + [("credit_card", 1), ("credit_card", -1), ("checking", 1), (None, 5)],
        "account_type string, amount int",
    )
    assert rows(bank.classified(df)) == [
        ("checking", 0, "expense"),
        ("checking", 1, "income"),
        ("checking", None, "expense"),
        ("credit_card", -1, "expense"),
        ("credit_card", 0, "expense"),
        ("credit_card", None, "expense"),
        (None, 5, "income"),
    ]


def test_files_of_one_known_header(spark, folder):
    path = folder(
        a=[CARD, "01/01/2024,01/02/2024,SHOP,Food,Sale,-12.34,"],
        b=[CARD, "01/01/2024,01/03/2024,BOOK,Fun,Sale,-5,,"],
    )
    df = bank_exports.read_alike_exports(spark, path, CARD.split(","))
    assert rows(df) == rows(bank_exports.read_exports(spark, path))
    folder(c=[CHECKING, "CREDIT,01/02/2024,PAY,1500.00,ACH,2500.00,"])
    with pytest.raises(Exception):
        bank_exports.read_alike_exports(spark, path, CARD.split(",")).collect()


@pytest.mark.parametrize("name", ["Card 05% (May) #1.csv", "a+b%20c.csv", "card[1]{x}.csv"])
def test_unusual_file_names(spark, tmp_path, name):
    (tmp_path / name).write_text(CARD + "\n01/01/2024,01/02/2024,SHOP,Food,Sale,-12.34,\n")
    assert rows(bank_exports.read_exports(spark, str(tmp_path)), "file_name", "amount") == [(name, m(-12.34))]
