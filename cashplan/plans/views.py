"""The engine's input tables, laid over TPC-H-like test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashplan.operators import typed

# Columns read from each test table.
_TABLES = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "lineitem": """l_partkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_discount DOUBLE,
                   l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _kind(key: str) -> str:
    return f"""CASE {key} % 5 WHEN 0 THEN 'oncely' WHEN 1 THEN 'yearly' WHEN 2 THEN 'monthly'
               WHEN 3 THEN 'biweekly' ELSE 'everyXDays' END"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recurring rules, typed except for ``When``."""
    anchored = _table(spark, sf_dir, "part").selectExpr(
        "*",
        f"{_kind('p_partkey')} AS Type",
        "date_add(DATE '1998-01-01', CAST(p_partkey * 37 % 1460 AS INT)) AS _Anchor",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS _Price",
    )
    return anchored.selectExpr(
        "p_partkey AS Row_Id",
        "p_type AS Category",
        "p_brand AS Sub_Category",
        "Type",
        """CASE Type WHEN 'yearly' THEN date_format(_Anchor, 'dd-MMM')
                     WHEN 'monthly' THEN CAST(dayofmonth(_Anchor) AS STRING)
                     ELSE date_format(_Anchor, 'MM/dd/yyyy') END AS `When`""",
        "p_name AS Account_Name",
        "CAST(if(p_size % 3 = 0, _Price, -_Price) AS DECIMAL(18,2)) AS Amount",
        "concat('acct_', p_partkey % 10) AS Auto_Pay_Account",
        "if(p_size % 2 = 0, 'full', 'minimum') AS Auto_Pay_Amount",
        "p_size % 10 AS AfterDays",
        "CAST(_Price * 1.0125 AS DECIMAL(28,8)) AS AverageMonthlyCost",
        "CAST(1 + p_partkey % 4 AS INT) AS Priority",
        "date_sub(_Anchor, p_size) AS Start_Date",
        "if(p_partkey % 7 <> 0, date_add(_Anchor, 365 + 10 * p_size), NULL) AS Maturity",
        "p_size AS _Size",
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule as the forecaster has it once typed."""
    return _rules(spark, sf_dir).withColumnRenamed("Maturity", "Maturity Date").drop("_Size")


def planner_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule as the planner has it once typed."""
    rules = _rules(spark, sf_dir).withColumnRenamed("Maturity", "Maturity_Date")
    return rules.select("Row_Id", *typed.PLANNER_COLUMNS)


def income_expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule as it arrives: all cells text, some blank."""
    return _rules(spark, sf_dir).selectExpr(
        "Row_Id",
        "Category",
        "Sub_Category",
        "Type",
        "`When`",
        "Account_Name",
        "CAST(Amount AS STRING) AS Amount",
        "Auto_Pay_Account",
        "Auto_Pay_Amount",
        "CAST(AfterDays AS STRING) AS AfterDays",
        "CAST(AverageMonthlyCost AS STRING) AS AverageMonthlyCost",
        "if(_Size % 2 = 0, '', CAST(AverageMonthlyCost AS STRING)) AS Balance",
        "if(_Size % 5 = 0, '', CAST(_Size * 100 AS STRING)) AS `Limit`",
        "if(_Size % 7 = 0, '', CAST(AverageMonthlyCost AS STRING)) AS `Available Credit`",
        "if(_Size % 4 = 0, '', concat(_Size, '%')) AS `Interest Rate`",
        "if(_Size % 6 = 0, '', CAST(_Size AS STRING)) AS `Monthly Interest Incurred`",
        "if(_Size % 3 = 0, '', CAST(_Size % 7 AS STRING)) AS `Payoff Order`",
        "date_format(Start_Date, 'MM/dd/yyyy') AS Start_Date",
        "coalesce(date_format(Maturity, 'MM/dd/yyyy'), '') AS `Maturity Date`",
        "CAST(Priority AS STRING) AS Priority",
    )


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last event of a day is the account's balance on that day."""
    events = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(ts AS DATE) AS Date", "user_id", "CAST(value AS DECIMAL(18,2)) AS value"
    )
    last = events.groupBy("Date", "user_id").agg(
        F.max_by("value", "event_id").alias("Balance"), F.max("event_id").alias("Row_Id")
    )
    return last.selectExpr("Row_Id", "Date", "concat('acct_', user_id) AS Account_Name", "Balance")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; those in debit have no category, and every tenth is listed by a name without balances."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS Row_Id",
        "concat(if(c_custkey % 10 = 0, 'account_', 'acct_'), c_custkey) AS Account_Name",
        "if(c_acctbal >= 0, lower(c_mktsegment), NULL) AS Category",
        "if(c_acctbal >= 0, concat('nation_', c_nationkey), NULL) AS Sub_Category",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: paid when finished, open otherwise."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    numbered = _table(spark, sf_dir, "orders").withColumn(
        "p_partkey", F.col("o_orderkey") % part.agg(F.count(F.lit(1))).scalar()
    )
    rows = numbered.join(part, "p_partkey").selectExpr(
        "*", "o_orderstatus = 'F' AS _Paid", "CAST(floor(o_totalprice / 1000) AS DECIMAL(18,2)) AS _Amount"
    )
    return rows.selectExpr(
        "o_orderkey AS Row_Id",
        "CAST(o_orderdate AS DATE) AS Date",
        "p_type AS Category",
        f"{_kind('o_orderkey')} AS Type",
        "p_name AS Account_Name",
        "concat('acct_', p_partkey % 10) AS Auto_Pay_Account",
        "CAST(if(_Paid, _Amount, -_Amount) AS DECIMAL(18,2)) AS Amount",
        "CAST(if(_Paid, _Amount, 0) AS DECIMAL(18,2)) AS Amount_Paid",
        "if(_Paid, date_format(o_orderdate, 'yyyy-MM-dd'), '') AS Date_Paid",
    )


def balances_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balances(spark, sf_dir).selectExpr(
        "Row_Id",
        "date_format(Date, 'MM/dd/yyyy') AS Date",
        "Account_Name",
        "CAST(Balance AS STRING) AS Balance",
    )


def details_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the cells a details table may hold: blanks, percentages, dates that are none."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS Row_Id",
        "c_name AS Account_Name",
        "c_mktsegment AS Category",
        "CAST(c_nationkey AS STRING) AS Sub_Category",
        "if(c_acctbal < 0, '', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING)) AS `Limit`",
        "if(c_custkey % 4 = 0, '', concat(c_custkey % 30, '%')) AS `Interest Rate`",
        """CASE c_custkey % 5 WHEN 0 THEN 'open-ended' WHEN 1 THEN ''
           ELSE date_format(date_add(DATE '2010-01-01', CAST(c_custkey AS INT)), 'MM/dd/yyyy') END
           AS `Maturity Date`""",
        "concat('account page ', c_custkey) AS Link",
    )


def ledger_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).selectExpr(
        "Row_Id",
        "date_format(Date, 'MM/dd/yyyy') AS Date",
        "Category",
        "Type",
        "Account_Name",
        "Auto_Pay_Account",
        "CAST(Amount AS STRING) AS Amount",
        "if(Amount_Paid = 0, '', CAST(Amount_Paid AS STRING)) AS Amount_Paid",
        "Date_Paid",
        "'' AS Running_Balance",
    )


def faulty_ledger_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with cells that cannot be read: dates that are none, amounts in words or finer than a cent."""
    return ledger_text(spark, sf_dir).withColumns(
        {
            "Date": F.expr("CASE WHEN Row_Id % 11 = 0 THEN 'soon' WHEN Row_Id % 13 = 0 THEN ' ' ELSE Date END"),
            "Amount": F.expr("CASE WHEN Row_Id % 7 = 0 THEN 'ten' WHEN Row_Id % 9 = 0 THEN concat(Amount, '5') ELSE Amount END"),
            "Amount_Paid": F.expr("CASE WHEN Row_Id % 17 = 0 THEN '-' ELSE Amount_Paid END"),
        }
    )


# Headers as banks write them, of a checking account (its lines end in a comma) and of a credit card.
CHECKING_HEADER = "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #,"
CARD_HEADER = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions as lines of export files, some quoted, with the file's ``header`` and ``file_name``."""
    cells = "nvl(CAST(amount AS STRING), if(description LIKE '%7', 'NaN', ''))"
    return bank_transactions(spark, sf_dir).selectExpr(
        "file_name",
        f"if(account_type = 'checking', '{CHECKING_HEADER}', '{CARD_HEADER}') AS header",
        f"""if(account_type = 'checking',
            concat_ws(',', 'DEBIT', post_date, concat('"', description, '"'), {cells}, type, '1.00', '', ''),
            concat_ws(',', post_date, post_date, description, 'None', type, {cells}, '"a ""memo"" of it"')) AS value""",
    )


def bank_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as bank transactions, in the shape the export reader yields."""
    line = _table(spark, sf_dir, "lineitem").selectExpr(
        "*", "if(l_linestatus = 'O', 'checking', 'credit_card') AS account_type"
    )
    return line.selectExpr(
        "account_type",
        "concat(account_type, '_', year(l_shipdate), '.csv') AS file_name",
        "date_format(l_shipdate, 'MM/dd/yyyy') AS post_date",
        "concat('part ', l_partkey) AS description",
        "l_returnflag AS type",
        """CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN -l_extendedprice
                WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount""",
    )


def balance_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account's balance on a day, asked once for each order; a third of them ask for one account."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS Question",
        "concat('acct_', if(o_orderkey % 3 = 0, 3, o_orderkey % 200)) AS Account_Name",
        "date_add(DATE '2023-12-30', datediff(o_orderdate, DATE '1995-01-01') % 40) AS Date",
    )


def large_order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of orders of over 400,000, one row an order."""
    orders = _table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return orders.selectExpr("CAST(o_orderdate AS DATE) AS Date")


def write_exports(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The same transactions as export files of both shapes; some descriptions hold line breaks and quotes."""
    rows = bank_transactions(spark, sf_dir).withColumn("description", F.expr(BROKEN_DESCRIPTION))
    checking = rows.where("account_type = 'checking'").selectExpr(
        "'DEBIT' AS Details", "post_date AS `Posting Date`", "description AS Description", "amount AS Amount", "type AS Type",
        "'1.00' AS Balance", "'' AS `Check or Slip #`",
    )
    card = rows.where("account_type = 'credit_card'").selectExpr(
        "post_date AS `Transaction Date`", "post_date AS `Post Date`", "description AS Description", "'Food' AS Category",
        "type AS Type", "amount AS Amount", "'' AS Memo",
    )
    for shape in (checking, card):
        as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        shape.write.mode("append").options(header=True, quote='"', escape='"', **as_is).csv(folder)


#: Descriptions as they stand in the export files.
BROKEN_DESCRIPTION = """CASE WHEN description LIKE '%3' THEN concat(description, '\n', '"second" line, of two')
  WHEN description LIKE '%44' THEN concat('"', description, '"\n\n') ELSE description END"""


def dated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of orders as four people would write them, some cells blank."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS Row_Id",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS Month_First",
        "date_format(o_orderdate, 'd.M.yyyy') AS Day_First",
        "concat(' ', date_format(o_orderdate, 'yyyy/M/d')) AS Year_First",
        "if(o_orderkey % 10 = 0, '', date_format(o_orderdate, 'd-MMM-yyyy')) AS Month_Name",
    )
