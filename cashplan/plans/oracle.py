"""DuckDB SQL for the registered queries, written the plain way: theta joins over days, dense grids, global windows."""

from __future__ import annotations

from cashplan.schemas import TRANSACTIONS_REPORT

_KIND = "CASE {key} % 5 WHEN 0 THEN 'oncely' WHEN 1 THEN 'yearly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'biweekly' ELSE 'everyXDays' END"

# Exact types inside; money as DECIMAL, dates as DATE. TS and DBL below convert at the edge.
_SCHEDULE = f"""
fx_rule AS (
  SELECT *, DATE '1998-01-01' + CAST(p_partkey * 37 % 1460 AS INTEGER) AS Anchor,
         {_KIND.format(key="p_partkey")} AS Kind, CAST(p_retailprice AS DECIMAL(18,2)) AS Price,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 1.0125 AS DECIMAL(28,8)) AS Cost
  FROM part),
fx_schedule AS (
  SELECT p_partkey AS Row_Id, Kind AS Type, Anchor,
    CASE Kind WHEN 'yearly' THEN strftime(Anchor, '%d-%b') WHEN 'monthly' THEN CAST(day(Anchor) AS VARCHAR)
              ELSE strftime(Anchor, '%m/%d/%Y') END AS "When",
    p_name AS Account_Name, p_type AS Category, p_brand AS Sub_Category,
    'acct_' || (p_partkey % 10) AS Auto_Pay_Account,
    CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'minimum' END AS Auto_Pay_Amount,
    CASE WHEN p_size % 3 = 0 THEN Price ELSE -Price END AS Amount,
    p_size % 10 AS After_Days, Price, Cost, p_size,
    Anchor - p_size AS Start_Date,
    CASE WHEN p_partkey % 7 <> 0 THEN Anchor + 365 + 10 * p_size END AS Maturity_Date,
    CAST(1 + p_partkey % 4 AS INTEGER) AS Priority
  FROM fx_rule)"""

_LEDGER = f"""
fx_ledger AS (
  SELECT o_orderkey AS Row_Id, CAST(o_orderdate AS DATE) AS Date, p_type AS Category,
    {_KIND.format(key="o_orderkey")} AS Type, p_name AS Account_Name,
    'acct_' || (p_partkey % 10) AS Auto_Pay_Account,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(floor(o_totalprice / 1000) AS DECIMAL(18,2))
      AS DECIMAL(18,2)) AS Amount,
    CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 1000) AS DECIMAL(18,2)) ELSE 0 END AS Amount_Paid,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS Date_Paid
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
retained AS (
  SELECT Row_Id, Date, Category, Type, Account_Name, Auto_Pay_Account, Amount, Amount_Paid, Date_Paid
  FROM fx_ledger WHERE Amount_Paid <> 0 OR Date < DATE '1999-01-01')"""

_BALANCES = """
fx_balances AS (
  SELECT CAST(ts AS DATE) AS Date, 'acct_' || user_id AS Account_Name,
         max_by(CAST(value AS DECIMAL(18,2)), event_id) AS Balance, max(event_id) AS Row_Id
  FROM events GROUP BY ALL)"""

_DETAILS = """
fx_details AS (
  SELECT c_custkey AS Row_Id, CASE WHEN c_custkey % 10 = 0 THEN 'account_' ELSE 'acct_' END || c_custkey AS Account_Name,
         CASE WHEN c_acctbal >= 0 THEN lower(c_mktsegment) END AS Category,
         CASE WHEN c_acctbal >= 0 THEN 'nation_' || c_nationkey END AS Sub_Category
  FROM customer)"""

_FILLED = """
grid AS (
  SELECT * FROM (SELECT DISTINCT Date FROM fx_balances), (SELECT DISTINCT Account_Name FROM fx_balances)),
filled AS (
  SELECT g.Date, g.Account_Name,
    last_value(b.Balance IGNORE NULLS) OVER (PARTITION BY g.Account_Name ORDER BY g.Date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Balance
  FROM grid g LEFT JOIN fx_balances b ON b.Date = g.Date AND b.Account_Name = g.Account_Name),
detailed AS (
  SELECT Date, f.Account_Name, Balance, Category, Sub_Category
  FROM filled f LEFT JOIN fx_details d ON d.Account_Name = f.Account_Name
  UNION ALL
  SELECT Date, 'Total', sum(Balance), 'Total', 'Total' FROM filled GROUP BY Date)"""

_OCCURRENCES = """
days AS (
  SELECT CAST(d AS DATE) AS Date
  FROM generate_series(DATE '1998-12-27', DATE '2000-12-31', INTERVAL 1 DAY) t(d)),
occ AS (
  SELECT s.*, d.Date,
    CASE Type WHEN 'oncely' THEN 1 WHEN 'yearly' THEN 2 WHEN 'monthly' THEN 3 WHEN 'biweekly' THEN 4 ELSE 5 END AS Kind_Rank
  FROM days d JOIN fx_schedule s ON s.Maturity_Date > d.Date AND (
       (Type = 'oncely' AND Anchor = d.Date)
    OR (Type = 'yearly' AND month(Anchor) = month(d.Date) AND day(Anchor) = day(d.Date))
    OR (Type = 'monthly' AND day(Anchor) = day(d.Date))
    OR (Type = 'biweekly' AND (d.Date - Anchor) % 14 = 0)
    OR (Type = 'everyXDays' AND After_Days > 0 AND (d.Date - Anchor) % After_Days = 0)))"""

_ENTRIES = """
united AS (
  SELECT Date, Category, Type, Account_Name, Auto_Pay_Account, Amount, Amount_Paid, Date_Paid, Row_Id,
         0 AS Source_Rank, 0 AS Kind_Rank FROM retained
  UNION ALL
  SELECT Date, Category, Type, Account_Name, Auto_Pay_Account, Amount, NULL, NULL, Row_Id, 1, Kind_Rank FROM occ),
entries AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Date, Account_Name ORDER BY Source_Rank, Kind_Rank, Row_Id) AS rn
    FROM united) WHERE rn = 1),
opening AS (
  SELECT max_by(Balance, Date) AS Opening FROM fx_balances WHERE Account_Name = 'acct_3')"""

_FORECAST = """
forecast AS (
  SELECT e.*, (SELECT Opening FROM opening)
      + sum(CASE WHEN Date_Paid IS NULL OR Date_Paid = '' THEN Amount ELSE 0 END)
        OVER (ORDER BY Date, Amount, Source_Rank, Kind_Rank, Row_Id ROWS UNBOUNDED PRECEDING) AS Running_Balance,
    row_number() OVER (ORDER BY Date, Amount, Source_Rank, Kind_Rank, Row_Id) AS Position
  FROM entries e),
ending AS (SELECT Date, max_by(Running_Balance, Position) AS Running_Balance FROM forecast GROUP BY Date),
alerts AS (
  SELECT * FROM ending WHERE Running_Balance < -12000000 AND DATE '1999-01-01' - Date <= 1),
labels AS (
  SELECT Date, Account_Name AS Label_Item, Amount AS Label_Amount, Position FROM forecast WHERE Type = 'oncely')"""

_PLAN = """
cal AS (
  SELECT CAST(d AS DATE) AS Date, CAST(year(d) AS INTEGER) AS Year, CAST(month(d) AS INTEGER) AS Month_of_Year,
         CAST(day(d) AS INTEGER) AS Day_of_Month, CAST(isodow(d) - 1 AS INTEGER) AS Day_of_Week
  FROM generate_series(DATE '2000-01-01', DATE '2100-12-31', INTERVAL 1 DAY) t(d)),
fortnights AS (
  SELECT Type, Account_Name, CAST(unnest(generate_series(least(Anchor, DATE '2000-01-01'), DATE '2100-12-31',
         INTERVAL 14 DAY)) AS DATE) AS Date, Start_Date, Maturity_Date, Amount, Row_Id
  FROM fx_schedule WHERE Type = 'biweekly'),
plan_all AS (
  SELECT c.*, s.Type, s.Account_Name, s.Start_Date, s.Maturity_Date, s.Amount, s.Row_Id
  FROM cal c JOIN fx_schedule s ON s.Type = 'monthly' AND day(s.Anchor) = c.Day_of_Month
  UNION ALL
  SELECT c.*, s.Type, s.Account_Name, s.Start_Date, s.Maturity_Date, s.Amount, s.Row_Id FROM cal c JOIN fx_schedule s
    ON s.Type = 'yearly' AND month(s.Anchor) = c.Month_of_Year AND day(s.Anchor) = c.Day_of_Month
  UNION ALL
  SELECT c.*, s.Type, s.Account_Name, s.Start_Date, s.Maturity_Date, s.Amount, s.Row_Id
  FROM cal c JOIN fx_schedule s ON s.Type = 'oncely' AND s.Anchor = c.Date
  UNION ALL
  SELECT c.*, f.Type, f.Account_Name, f.Start_Date, f.Maturity_Date, f.Amount, f.Row_Id
  FROM cal c JOIN fortnights f ON f.Date = c.Date),
plan AS (
  SELECT * FROM plan_all WHERE Amount IS NOT NULL AND Start_Date <= Date
    AND (Maturity_Date IS NULL OR Date <= Maturity_Date))"""

_BANK = """
fx_bank AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'checking' ELSE 'credit_card' END AS account_type,
    strftime(l_shipdate, '%m/%d/%Y') AS post_date, 'part ' || l_partkey AS description, l_returnflag AS type,
    year(l_shipdate) AS ship_year,
    CASE WHEN l_linenumber = 7 THEN NULL
         WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
         WHEN l_discount = 0 THEN 0
         ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount
  FROM lineitem)"""

_DATES = {"Date", "Start_Date", "Maturity_Date", "Occur_Date", "Maturity Date"}
_MONEY = {
    "Amount",
    "Amount_Paid",
    "Running_Balance",
    "Balance",
    "Label_Amount",
    "AverageMonthlyCost",
    "Emergency_Fund_Amount",
    "amount",
}


def _columns(*names: str) -> str:
    """Select list with the edge types: TIMESTAMP for dates, DOUBLE for money."""
    picked = []
    for name in names:
        if name in _DATES:
            picked.append(f'CAST("{name}" AS TIMESTAMP) AS "{name}"')
        elif name in _MONEY:
            picked.append(f'CAST("{name}" AS DOUBLE) AS "{name}"')
        else:
            picked.append(f'"{name}"')
    return ", ".join(picked)


def _sql(ctes: list[str], columns: tuple[str, ...], rest: str) -> str:
    return f"WITH {','.join(ctes)}\nSELECT {_columns(*columns)} {rest}"


_SCHEDULE_TYPED = """
typed AS (
  SELECT Row_Id, Category, Sub_Category, Type, "When", Account_Name, Amount, Auto_Pay_Account, Auto_Pay_Amount,
    After_Days AS "AfterDays", Cost AS "AverageMonthlyCost",
    CASE WHEN p_size % 2 = 0 THEN 0 ELSE CAST(Cost AS DOUBLE) END AS "Balance",
    CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 100 END AS DOUBLE) AS "Limit",
    CASE WHEN p_size % 7 = 0 THEN 0 ELSE CAST(Cost AS DOUBLE) END AS "Available Credit",
    CASE WHEN p_size % 4 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) / 100 END AS "Interest Rate",
    CAST(CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS "Monthly Interest Incurred",
    CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % 7 END AS "Payoff Order",
    strftime(Start_Date, '%m/%d/%Y') AS "Start_Date_Text", Maturity_Date AS "Maturity Date", Priority
  FROM fx_schedule)"""

_TYPED_SCHEDULE = (
    "Row_Id",
    "Category",
    "Sub_Category",
    "Type",
    "When",
    "Account_Name",
    "Amount",
    "Auto_Pay_Account",
    "Auto_Pay_Amount",
    "AfterDays",
    "AverageMonthlyCost",
    "Balance",
    "Limit",
    "Available Credit",
    "Interest Rate",
    "Monthly Interest Incurred",
    "Payoff Order",
    "Maturity Date",
    "Priority",
)
_ENTRY = ("Date", "Category", "Type", "Account_Name", "Auto_Pay_Account", "Amount", "Amount_Paid", "Date_Paid")
_OCC = ("Row_Id", "Date", "Kind_Rank", "Type", "Category", "Account_Name", "Auto_Pay_Account", "Amount")
_VALID = ("Start_Date", "Maturity_Date", "Amount")
_CAL = ("Date", "Year", "Month_of_Year", "Day_of_Month", "Day_of_Week")
_PLAN_COLUMNS = (*_CAL, "Type", "Account_Name", *_VALID, "Row_Id")

_TO_OCC = [_SCHEDULE, _OCCURRENCES]
_TO_ENTRIES = [*_TO_OCC, _LEDGER, _BALANCES, _ENTRIES]
_TO_FORECAST = [*_TO_ENTRIES, _FORECAST]
_TO_PLAN = [_SCHEDULE, _PLAN]


def _occ(kind: str) -> str:
    return _sql(_TO_OCC, _OCC, f"FROM occ WHERE Type = '{kind}'")


_WIDE_CELLS = f"""
WITH {",".join([_BALANCES, _DETAILS, _FILLED])},
seen AS (
  SELECT 'Total_' || Category AS Col, min(Row_Id) AS Seen FROM fx_details WHERE Category IS NOT NULL GROUP BY ALL),
accounts AS (
  SELECT Date, Account_Name AS Col, coalesce(Balance, 0) AS Balance, 0 AS Place, 0 AS Seen FROM filled),
categories AS (
  SELECT Date, 'Total_' || Category AS Col, sum(coalesce(Balance, 0)) AS Balance
  FROM filled f JOIN fx_details d ON d.Account_Name = f.Account_Name WHERE Category IS NOT NULL GROUP BY ALL),
cells AS (
  SELECT * FROM accounts UNION ALL SELECT Date, Col, Balance, 1, Seen FROM categories JOIN seen USING (Col)),
wide AS (
  SELECT * FROM cells UNION ALL SELECT Date, 'Total', sum(Balance), 2, 0 FROM cells GROUP BY Date)"""
_WIDE = f"""{_WIDE_CELLS}
SELECT CAST(Date AS TIMESTAMP) AS Date, Col AS "Column", CAST(Balance AS DOUBLE) AS Balance, Place, CAST(Seen AS BIGINT) AS Seen
FROM wide"""
_WIDE_TOTALS = f"""SELECT * FROM (
  PIVOT ({_WIDE_CELLS}
    SELECT CAST(Date AS TIMESTAMP) AS Date, Col, CAST(Balance AS DECIMAL(28,2)) AS Balance FROM wide)
  ON Col IN ('Total_automobile', 'Total_building', 'Total_furniture', 'Total_household', 'Total_machinery', 'Total')
  USING CAST(sum(Balance) AS DOUBLE) GROUP BY Date)"""

_WIDE_BLOCKS = f"""{_WIDE_CELLS},
directory AS (
  SELECT Col, row_number() OVER (ORDER BY Place, Seen, Col) - 1 AS i FROM (SELECT DISTINCT Col, Place, Seen FROM wide))
SELECT CAST(Date AS TIMESTAMP) AS Date, i // 1024 AS Block,
  string_agg(CAST(CAST(Balance AS DECIMAL(28,2)) AS VARCHAR), ',' ORDER BY i) AS Balances
FROM wide JOIN directory USING (Col) GROUP BY ALL"""

# the kinds in the order of PLAN_KINDS
_KIND_RANK = "CASE Type WHEN 'monthly' THEN 1 WHEN 'yearly' THEN 2 WHEN 'oncely' THEN 3 ELSE 4 END"

_PUBLISHED = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS Section, Type, Account_Name, CAST(Amount AS DOUBLE) AS Amount FROM fx_schedule WHERE Type = '{kind}'"""
    for name, kind in (
        ("Monthly_Budgets", "monthly"),
        ("Yearly_Budgets", "yearly"),
        ("One_Time_Budgets", "oncely"),
        ("Bi_Weekly_Budgets", "biweekly"),
    )
)

_EXPORTS_READ = f"""WITH {_BANK}
SELECT account_type, post_date, type, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN description LIKE '%3' THEN description || chr(10) || '"second" line, of two'
    WHEN description LIKE '%44' THEN '"' || description || '"' || chr(10) || chr(10) ELSE description END AS description,
  CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS income_or_expense
FROM fx_bank
WHERE amount IS NULL OR NOT (account_type = 'checking' AND amount < 0 OR account_type = 'credit_card' AND amount > 0)"""

_DATES_INFERRED = """
SELECT o_orderkey AS Row_Id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS Month_First,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS Day_First, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS Year_First,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS Month_Name
FROM orders"""


_BANK_CLASSIFIED = _sql(
    [_BANK],
    ("account_type", "post_date", "description", "type", "amount"),
    """, account_type || '_' || ship_year || '.csv' AS file_name,
  CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS income_or_expense
FROM fx_bank
WHERE amount IS NULL OR NOT (account_type = 'checking' AND amount < 0 OR account_type = 'credit_card' AND amount > 0)""",
)


def oracle_sql() -> dict[str, str]:
    return {
        "typed_schedule": _sql(
            [_SCHEDULE, _SCHEDULE_TYPED], _TYPED_SCHEDULE, ', "Start_Date_Text" AS "Start_Date" FROM typed'
        ),
        "typed_planner_schedule": _sql(
            [_SCHEDULE],
            ("Row_Id", "Type", "When", "Account_Name", "Auto_Pay_Account", "Auto_Pay_Amount", *_VALID),
            "FROM fx_schedule",
        ),
        "typed_balances": _sql(
            [_BALANCES], ("Row_Id", "Date", "Account_Name", "Balance"), "FROM fx_balances"
        ),
        "typed_details": """
SELECT c_custkey AS Row_Id, c_name AS Account_Name, c_mktsegment AS Category,
  CAST(c_nationkey AS VARCHAR) AS Sub_Category,
  CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS DOUBLE) AS "Limit",
  CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE CAST(c_custkey % 30 AS DOUBLE) / 100 END AS "Interest Rate",
  CAST(CASE WHEN c_custkey % 5 > 1 THEN DATE '2010-01-01' + CAST(c_custkey AS INTEGER) END AS TIMESTAMP)
    AS "Maturity Date",
  'account page ' || c_custkey AS Link
FROM customer""",
        "typed_ledger": _sql(
            [_LEDGER], ("Row_Id", *_ENTRY), ", CAST(0 AS DOUBLE) AS Running_Balance FROM fx_ledger"
        ),
        "parse_percent": """
SELECT p_partkey AS Row_Id, CASE WHEN p_size % 4 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) / 100 END AS Interest_Rate
FROM part""",
        "ffill": _sql(
            [_BALANCES, _DETAILS, _FILLED], ("Date", "Account_Name", "Balance"), "FROM filled"
        ),
        "balances_filled": _sql(
            [_BALANCES, _DETAILS, _FILLED],
            ("Date", "Account_Name", "Balance", "Category", "Sub_Category"),
            "FROM detailed",
        ),
        "balances_wide": _WIDE,
        "balances_wide_totals": _WIDE_TOTALS,
        "balances_wide_blocks": _WIDE_BLOCKS,
        "balances_by_sub_category": _sql(
            [
                _BALANCES,
                _DETAILS,
                _FILLED,
                """ sums AS (
  SELECT Date, Sub_Category, coalesce(sum(Balance), 0) AS Balance FROM detailed
  WHERE Sub_Category IS NOT NULL GROUP BY Date, Sub_Category)""",
            ],
            ("Date", "Sub_Category", "Balance"),
            "FROM sums",
        ),
        "current_balance": _sql(
            [
                _BALANCES,
                """ latest AS (
  SELECT * FROM fx_balances b WHERE Date = (SELECT max(Date) FROM fx_balances x WHERE x.Account_Name = b.Account_Name))""",
            ],
            ("Account_Name", "Date", "Balance"),
            "FROM latest",
        ),
        "cells_rejected": f"""WITH {_LEDGER},
faulty AS (
  SELECT Row_Id, Amount_Paid <> 0 AS Paid,
    CASE WHEN Row_Id % 11 = 0 THEN 'soon' WHEN Row_Id % 13 = 0 THEN ' ' ELSE strftime(Date, '%m/%d/%Y') END AS Day,
    CASE WHEN Row_Id % 7 = 0 THEN 'ten' WHEN Row_Id % 9 = 0 THEN Amount || '5' ELSE Amount::VARCHAR END AS Sum
  FROM fx_ledger),
cells AS (
  SELECT Row_Id, 'Date' AS "Column", 'not a date' AS Fault, Day AS Cell FROM faulty WHERE Day = 'soon'
  UNION ALL SELECT Row_Id, 'Amount', 'not a number', Sum FROM faulty WHERE Sum = 'ten'
  UNION ALL SELECT Row_Id, 'Amount', 'too many digits', Sum FROM faulty WHERE Row_Id % 9 = 0 AND Row_Id % 7 <> 0
  UNION ALL SELECT Row_Id, 'Amount_Paid', 'not a number', '-' FROM faulty WHERE Row_Id % 17 = 0
  UNION ALL SELECT Row_Id, 'Date', 'unpaid without a date', Day FROM faulty WHERE Day = ' ' AND NOT Paid AND Row_Id % 17 <> 0)
SELECT '{TRANSACTIONS_REPORT}' AS "Table", * FROM cells""",
        "balances_as_of": f"""WITH {_BALANCES},
asked AS (
  SELECT o_orderkey AS Question, 'acct_' || CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_orderkey % 200 END AS Account_Name,
    DATE '2023-12-30' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 40 AS INTEGER) AS Date
  FROM orders)
SELECT Question, a.Account_Name, CAST(a.Date AS TIMESTAMP) AS Date, CAST(max(b.Date) AS TIMESTAMP) AS Balance_Date,
  CAST(max_by(Balance, b.Date) AS DOUBLE) AS Balance
FROM asked a LEFT JOIN fx_balances b ON b.Account_Name = a.Account_Name AND b.Date <= a.Date
GROUP BY Question, a.Account_Name, a.Date""",
        "emergency_fund": f"""WITH {_SCHEDULE}
SELECT CAST(coalesce(sum(Cost), 0) * 6 AS DOUBLE) AS Emergency_Fund_Amount FROM fx_schedule WHERE Priority = 1""",
        "occ_oncely": _occ("oncely"),
        "occ_yearly": _occ("yearly"),
        "occ_monthly": _occ("monthly"),
        "occ_biweekly": _occ("biweekly"),
        "occ_every_x_days": _occ("everyXDays"),
        "occ_for_date": _sql(_TO_OCC, _OCC, "FROM occ WHERE Date = DATE '1999-01-01'"),
        "expected_occurrences": _sql(
            [*_TO_OCC, " expected AS (SELECT *, NULL AS Amount_Paid, CAST(NULL AS VARCHAR) AS Date_Paid FROM occ)"],
            (*_ENTRY, "Kind_Rank", "Row_Id"),
            "FROM expected",
        ),
        "ledger_retained": _sql([_LEDGER], (*_ENTRY, "Row_Id"), "FROM retained"),
        "ledger_union_expected": _sql(
            _TO_ENTRIES, (*_ENTRY, "Row_Id", "Source_Rank", "Kind_Rank"), "FROM united"
        ),
        "dedup_keep_first": _sql(
            _TO_ENTRIES, (*_ENTRY, "Row_Id", "Source_Rank", "Kind_Rank"), "FROM entries"
        ),
        "running_balance": _sql(
            [
                _LEDGER,
                _BALANCES,
                """ run AS (
  SELECT Row_Id, Date, Amount, Date_Paid,
    (SELECT max_by(Balance, Date) FROM fx_balances WHERE Account_Name = 'acct_3')
      + sum(CASE WHEN Date_Paid IS NULL OR Date_Paid = '' THEN Amount ELSE 0 END)
        OVER (ORDER BY Date, Amount, Row_Id ROWS UNBOUNDED PRECEDING) AS Running_Balance,
    row_number() OVER (ORDER BY Date, Amount, Row_Id) AS Position
  FROM fx_ledger)""",
            ],
            ("Row_Id", "Date", "Amount", "Date_Paid", "Running_Balance", "Position"),
            "FROM run",
        ),
        "forecast": _sql(
            _TO_FORECAST,
            (*_ENTRY, "Row_Id", "Source_Rank", "Kind_Rank", "Running_Balance", "Position"),
            "FROM forecast",
        ),
        "forecast_from_last": _sql(
            _TO_FORECAST,
            (*_ENTRY, "Row_Id", "Source_Rank", "Kind_Rank", "Running_Balance", "Position"),
            "FROM forecast",
        ),
        "label_dates": _sql(_TO_FORECAST, ("Date", "Label_Item", "Label_Amount"), "FROM labels"),
        "ending_daily_balance": _sql(_TO_FORECAST, ("Date", "Running_Balance"), "FROM ending"),
        "alert_dates": _sql(_TO_FORECAST, ("Date", "Running_Balance"), "FROM alerts"),
        "daily_balance_report": _sql(
            [
                *_TO_FORECAST,
                """ report AS (
  SELECT e.Date, Running_Balance, coalesce(Label_Item, '') AS Label_Item, Label_Amount,
    -(SELECT coalesce(sum(Cost), 0) * 6 FROM fx_schedule WHERE Priority = 1) AS Emergency_Fund_Amount,
    CAST(1000 AS INTEGER) AS Alert_Threshold, CAST(0 AS INTEGER) AS Zero
  FROM ending e LEFT JOIN labels l ON l.Date = e.Date
  WHERE DATE '1999-01-01' - e.Date <= 10)""",
            ],
            (
                "Date",
                "Running_Balance",
                "Label_Item",
                "Label_Amount",
                "Emergency_Fund_Amount",
                "Alert_Threshold",
                "Zero",
            ),
            "FROM report",
        ),
        "summary_top30": _sql(
            [
                *_TO_FORECAST,
                """ summary AS (
  SELECT 'alert' AS Section, Date, '' AS Item, Running_Balance AS Amount
  FROM (SELECT * FROM alerts ORDER BY Date LIMIT 30)
  UNION ALL
  SELECT 'label', Date, Label_Item, Label_Amount FROM (SELECT * FROM labels ORDER BY Position LIMIT 30))""",
            ],
            ("Section", "Date", "Item", "Amount"),
            "FROM summary",
        ),
        "calendar": """
SELECT d AS Date, CAST(year(d) AS INTEGER) AS Year, CAST(month(d) AS INTEGER) AS Month_of_Year,
       CAST(day(d) AS INTEGER) AS Day_of_Month, CAST(isodow(d) - 1 AS INTEGER) AS Day_of_Week
FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d
      FROM orders)""",
        "plan_rules_monthly": _sql(
            [_SCHEDULE],
            ("Type", "Account_Name", *_VALID),
            ", CAST(day(Anchor) AS INTEGER) AS Day_of_Month FROM fx_schedule WHERE Type = 'monthly'",
        ),
        "plan_rules_yearly": _sql(
            [_SCHEDULE],
            ("Type", "Account_Name", *_VALID),
            ", CAST(month(Anchor) AS INTEGER) AS Month_of_Year, CAST(day(Anchor) AS INTEGER) AS Day_of_Month"
            " FROM fx_schedule WHERE Type = 'yearly'",
        ),
        "plan_rules_one_time": _sql(
            [_SCHEDULE],
            ("Type", "Account_Name", *_VALID),
            ", CAST(Anchor AS TIMESTAMP) AS Date FROM fx_schedule WHERE Type = 'oncely'",
        ),
        "plan_rules_biweekly": _sql(
            [_SCHEDULE],
            ("Type", "Account_Name", *_VALID),
            ", CAST(Anchor AS TIMESTAMP) AS Occur_Date FROM fx_schedule WHERE Type = 'biweekly'",
        ),
        "plan_biweekly_occurrences": _sql(
            _TO_PLAN, ("Type", "Account_Name", "Date", *_VALID), "FROM fortnights"
        ),
        "planned_budget": _sql(_TO_PLAN, _PLAN_COLUMNS, "FROM plan"),
        "planned_budget_order": _sql(
            _TO_PLAN,
            _PLAN_COLUMNS,
            f", row_number() OVER (ORDER BY Date, Amount DESC NULLS LAST, {_KIND_RANK}, Row_Id) AS Position FROM plan",
        ),
        "planned_budget_window": _sql(
            _TO_PLAN, _PLAN_COLUMNS, "FROM plan WHERE Date BETWEEN DATE '2000-10-01' AND DATE '2000-10-31'"
        ),
        "planned_budget_on_days": _sql(
            _TO_PLAN,
            _PLAN_COLUMNS,
            "FROM plan WHERE Date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 400000)",
        ),
        "rules_published": f"WITH {_SCHEDULE}\n{_PUBLISHED}",
        "typed_dates_inferred": _DATES_INFERRED,
        "exports_read": _EXPORTS_READ,
        "bank_canonical": _BANK_CLASSIFIED,
        "bank_classified": _BANK_CLASSIFIED,
    }
