import pytest

from cashplan.functions import date_formats
from cashplan.functions.date_formats import DateFormatError, inferred_formats, with_inferred_dates
from helpers import D, rows


def frame(spark, *cells):
    return spark.createDataFrame([(cell,) for cell in cells], "Date string")


@pytest.mark.parametrize(
    "cells, want",
    [
        (["2024-02-03", "2024-12-31"], "yyyy-MM-dd"),
        (["1/2/2024", "01/13/2024"], "M/d/yyyy"),
        (["1/2/2024", "13/01/2024"], "d/M/yyyy"),
        (["3.2.2024", "", None, " 31.12.2024 "], "d.M.yyyy"),
        (["3-Feb-2024"], "d-MMM-yyyy"),
        (["Feb 3, 2024"], "MMM d, yyyy"),
        (["20240203"], "yyyyMMdd"),
        (["2024-02-03 10:11:12"], "yyyy-MM-dd HH:mm:ss"),
        (["3/3/2024", "12/12/2024"], "M/d/yyyy"),  # no cell means two dates
        (["", None], None),
        ([], None),
    ],
)
def test_the_one_format_left(spark, cells, want):
    assert inferred_formats(frame(spark, *cells), ["Date"]) == {"Date": want}


def test_ambiguous_and_mixed_columns_raise_with_an_example(spark):
    with pytest.raises(DateFormatError, match="Date: '1/2/2024' is a date as M/d/yyyy and as d/M/yyyy"):
        inferred_formats(frame(spark, "1/2/2024", "3/3/2024"), ["Date"])
    with pytest.raises(DateFormatError, match="no format reads all of '01/13/2024' .M/d/yyyy., '13/01/2024' .d/M/yyyy."):
        inferred_formats(frame(spark, "13/01/2024", "01/13/2024"), ["Date"])
    with pytest.raises(DateFormatError, match="Date: 'soon' is in no known format"):
        inferred_formats(frame(spark, "2024-01-01", "soon"), ["Date"])
    assert inferred_formats(frame(spark, "1/2/2024"), ["Date"], prefer=("d/M/yyyy", "M/d/yyyy")) == {"Date": "d/M/yyyy"}


def test_dates_of_several_columns(spark):
    df = spark.createDataFrame([(1, "13.1.2024", "2024/1/2"), (2, "", None)], "Row_Id int, `Occur Date` string, B string")
    assert rows(with_inferred_dates(df, ["Occur Date", "B"])) == [(1, D("2024-01-13"), D("2024-01-02")), (2, None, None)]


def test_every_format_reads_what_it_writes(spark):
    day = spark.range(1).selectExpr("DATE '2024-11-23' AS d")
    for i, form in enumerate(date_formats.FORMATS):
        shown = day.selectExpr(f'date_format(d, "{form}") AS Date')
        assert shown.select(date_formats.bits(shown.Date).alias("b")).first().b >> i & 1


def test_shapes_of_formats():
    assert date_formats.shape("yyyyMMdd") == r"^\d{4}\d{2}\d{2}$"
    assert date_formats.shape("d.M.yyyy") == r"^\d{1,2}\.\d{1,2}\.\d{4}$"
