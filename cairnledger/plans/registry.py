"""The registered queries of the ledger engine, each with the SQL that states the same over the same tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import categories, geometry, identity, layout, recurrence, spending, statements, transfers
from ..operators.grouped import dealt_join
from ..sources.driver_tables import CTES, Ledger, ledger
from . import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "agg_01_spending_summary"


def query(sql: str | None = None, *ctes: str):
    """Registers a function of (spark, sf_dir) under its name, with its SQL if SQL can state it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {', '.join(c.strip() for c in ctes)} {sql}" if ctes else sql
        return f

    return put


def over_ledger(sql: str | None = None):
    """The same, for a function of a ledger."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ledger(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql, CTES)(run) if sql is not None else query()(run)

    return put


OUT, IN, NET = "amount_minor < 0", "amount_minor > 0 AND kind <> 'card'", "(amount_minor < 0 OR kind <> 'card')"
SINCE, UNTIL = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
RANGE = f"posted_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'"
BIG = "CAST(sum({}) AS BIGINT)"
LABELLED = "(SELECT b.*, e.category FROM base b LEFT JOIN enrichment e USING (txn_id))"


@over_ledger(f"SELECT category, count(*) AS n_rows, {BIG.format('effective')} AS total_minor FROM {LABELLED} WHERE {OUT} GROUP BY category")
def agg_01_spending_summary(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.spending_summary(l, "out")


@over_ledger(f"SELECT category, count(*) AS n_rows, {BIG.format('effective')} AS total_minor FROM {LABELLED} WHERE {IN} AND {RANGE} GROUP BY category")
def flt_02_income_summary(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.spending_summary(l, "in", since=SINCE, until=UNTIL)


@over_ledger(f"SELECT category, count(*) AS n_rows, {BIG.format('effective')} AS total_minor FROM {LABELLED} WHERE {NET} AND account_id IN (1, 2, 3, 4, 5, 8) AND category IN ('Grocery', 'Travel') GROUP BY category")
def flt_04_net_of_accounts(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.spending_summary(l, "net", accounts=[1, 2, 3, 4, 5, 8], categories=["Grocery", "Travel"])


@over_ledger(f"SELECT txn_id, account_id, posted_date, amount_minor, effective, category, counterparty_norm FROM {LABELLED} WHERE {NET} AND (contains(upper(counterparty_norm), 'SHOP 4') OR contains(upper(description_raw), 'SHOP 4'))")
def flt_05_search(l: Ledger) -> DataFrame:  # noqa: E741
    rows = spending.filtered(spending.with_category(spending.spending_base(l, "net"), l), SINCE, UNTIL, text="shop 4")
    return rows.select("txn_id", "account_id", "posted_date", "amount_minor", "effective", "category", "counterparty_norm")


@over_ledger("""SELECT txn_id, account_id, posted_date, amount_minor FROM txn WHERE amount_minor < 0
    AND txn_id NOT IN (SELECT out_txn_id FROM transfer_link) AND txn_id NOT IN (SELECT in_txn_id FROM transfer_link WHERE in_txn_id IS NOT NULL)""")
def flt_08_targets(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.targets(l).select("txn_id", "account_id", "posted_date", "amount_minor")


@over_ledger(f"""SELECT total_minor, CAST(round_even(total_minor / 16.0, 0) AS BIGINT) AS per_day, CAST(round_even(total_minor * 7 / 16.0, 0) AS BIGINT) AS per_week,
    CAST(round_even(total_minor * 30 / 16.0, 0) AS BIGINT) AS per_month FROM (SELECT {BIG.format('effective')} AS total_minor FROM base WHERE {OUT} AND {RANGE})""")
def agg_02_averages(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.averages(l, SINCE, UNTIL)


@over_ledger(f"SELECT expense_txn_id AS txn_id, {BIG.format('i.amount_minor')} AS paid FROM payback JOIN txn i ON i.txn_id = income_txn_id GROUP BY 1")
def agg_03_paid_back(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.paid_back(l)


def trend_sql(width: str) -> str:
    return f"""SELECT CAST(date_trunc('{width}', posted_date) AS DATE) AS bucket, CAST(sum(CASE WHEN effective < 0 THEN effective ELSE 0 END) AS BIGINT) AS out_minor,
        CAST(sum(CASE WHEN effective >= 0 THEN effective ELSE 0 END) AS BIGINT) AS in_minor, {BIG.format('effective')} AS net_minor, count(*) AS n_rows
        FROM base WHERE {NET} GROUP BY 1"""


@over_ledger(trend_sql("week"))
def agg_04_trend(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.trend(l, "week")


@over_ledger(f"SELECT *, CAST(round_even(sum(out_minor) OVER w / CAST(count(*) OVER w AS DOUBLE), 0) AS BIGINT) AS rolling_minor, count(*) OVER w AS rolling_of FROM ({trend_sql('day')}) WINDOW w AS (ORDER BY bucket ROWS 6 PRECEDING)")
def win_01_rolling(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.rolling(spending.trend(l, "day"), "day")


@over_ledger(f"SELECT CAST(round_even(avg(out_minor), 0) AS BIGINT) AS mean_minor, CAST(round_even(median(out_minor), 0) AS BIGINT) AS median_minor FROM ({trend_sql('day')}) WHERE out_minor < 0")
def agg_06_trend_centre(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.trend_centre(spending.trend(l, "day"))


@over_ledger(f"SELECT category, count(*) AS n_rows, {BIG.format('amount_minor')} AS total_minor FROM enrichment JOIN txn USING (txn_id) GROUP BY 1")
def agg_07_category_totals(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.category_totals(l)


@over_ledger("SELECT counterparty_norm, count(*) AS n_rows FROM txn WHERE counterparty_norm IN (SELECT counterparty_norm FROM txn JOIN hidden USING (txn_id)) GROUP BY 1")
def agg_08_counterparty_counts(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.counterparty_counts(l, l.txn.join(l.hidden, "txn_id", "left_semi").select("counterparty_norm"))


@over_ledger("""SELECT institution, count(*) AS n_accounts, count(*) FILTER (kind = 'card') AS n_cards, CAST(sum(n) AS BIGINT) AS n_txns, CAST(sum(s) AS BIGINT) AS n_statements FROM account
    LEFT JOIN (SELECT account_id, count(*) AS n FROM txn GROUP BY 1) USING (account_id) LEFT JOIN (SELECT account_id, count(*) AS s FROM balance GROUP BY 1) USING (account_id) GROUP BY 1""")
def agg_09_counts(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.counts(l)


MOVEMENT = """SELECT account_id, least(posted_date, period_end) AS day, CAST(sum(amount_minor) AS BIGINT) AS moved_minor FROM txn
    JOIN balance USING (document_id, account_id) GROUP BY 1, 2"""


@over_ledger(MOVEMENT)
def agg_10_daily_movement(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.daily_movement(l)


@over_ledger("SELECT count(DISTINCT currency) AS n_currencies, min(currency) AS currency FROM txn")
def agg_11_currencies(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.currencies(l)


@over_ledger(f"SELECT count(*) AS n_rows, coalesce({BIG.format('amount_minor')}, 0) AS total_minor FROM txn JOIN hidden USING (txn_id)")
def agg_12_hidden_total(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.hidden_total(l)


@over_ledger("SELECT count(DISTINCT expense_txn_id) AS n_charges, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM payback JOIN txn ON txn_id = income_txn_id")
def agg_12_payback_total(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.payback_total(l)


@over_ledger(f"SELECT txn_id, account_id, posted_date, amount_minor, effective, category, counterparty_norm FROM {LABELLED} WHERE {OUT} ORDER BY posted_date DESC, txn_id DESC LIMIT 200 OFFSET 50")
def top_01_listing(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.listing(l, "out", limit=200, offset=50)


@over_ledger("""SELECT out_txn_id, o.amount_minor AS out_minor, in_txn_id, i.amount_minor AS in_minor, origin FROM transfer_link
    JOIN txn o ON o.txn_id = out_txn_id LEFT JOIN txn i ON i.txn_id = in_txn_id""")
def jn_06_transfer_decisions(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.decisions(l)


@over_ledger("""SELECT expense_txn_id, e.amount_minor AS expense_minor, income_txn_id, i.amount_minor AS income_minor FROM payback
    JOIN txn e ON e.txn_id = expense_txn_id JOIN txn i ON i.txn_id = income_txn_id""")
def jn_07_payback_pairs(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.payback_pairs(l)


def nearest_inflows(within: str, which: str, limit: int) -> str:
    """Inflows of any account for each purchase in one shop, nearest first by days, of as near ones the latest id."""
    return f"""SELECT charge_id, txn_id, account_id, amount_minor, days_apart FROM (SELECT *, row_number() OVER (PARTITION BY charge_id ORDER BY days_apart, txn_id DESC) AS n FROM
        (SELECT c.txn_id AS charge_id, i.txn_id, i.account_id, i.amount_minor, abs(date_diff('day', c.posted_date, i.posted_date)) AS days_apart
        FROM (SELECT txn_id, posted_date FROM txn WHERE counterparty_norm = 'PURCHASE SHOP 97') c CROSS JOIN (SELECT * FROM base WHERE {IN} AND {which}) i) WHERE {within}) WHERE n <= {limit}"""


def some_charges(l: Ledger) -> DataFrame:  # noqa: E741
    return l.txn.where("counterparty_norm = 'PURCHASE SHOP 97'").select("txn_id")


@over_ledger(nearest_inflows("days_apart <= 1", "true", 100))
def top_04_payback_candidates(l: Ledger) -> DataFrame:  # noqa: E741
    """Of purchases on any account, cards among them, of which hardly any has been paid back."""
    r = spending.payback_candidates(l, some_charges(l), days=1)
    return r.withColumn("days_apart", F.col("days_apart").cast("long"))


PAIRS = """SELECT o.txn_id AS out_txn_id, i.txn_id AS in_txn_id, -o.amount_minor AS amount, abs(date_diff('day', o.posted_date, i.posted_date)) AS days_apart,
    oa.kind = 'deposit' AND ia.kind = 'card' AS pays_card FROM txn o JOIN txn i ON i.amount_minor = -o.amount_minor AND o.amount_minor < 0 AND i.account_id <> o.account_id
    JOIN account oa ON oa.account_id = o.account_id JOIN account ia ON ia.account_id = i.account_id
    WHERE o.txn_id NOT IN (SELECT out_txn_id FROM transfer_link WHERE origin = 'manual') AND i.txn_id NOT IN (SELECT out_txn_id FROM transfer_link WHERE origin = 'manual')"""


@over_ledger(f"SELECT out_txn_id, in_txn_id, amount, days_apart, pays_card AND days_apart <= 21 AS pays_card FROM ({PAIRS}) WHERE days_apart <= 4 OR (pays_card AND days_apart <= 21)")
def jn_13_transfer_candidates(l: Ledger) -> DataFrame:  # noqa: E741
    pairs = transfers.candidates(transfers.legs_of(l))
    return pairs.select("out_txn_id", "in_txn_id", "amount", F.col("days_apart").cast("long").alias("days_apart"), F.get("passes", 2).alias("pays_card"))


@over_ledger()
def trf_04_find_transfers(l: Ledger) -> DataFrame:  # noqa: E741
    """Sequential settling: tested against brute force."""
    return transfers.find_transfers(transfers.legs_of(l))


SURE = f"""sure AS (SELECT out_txn_id, in_txn_id, amount, CASE WHEN pays_card AND days_apart <= 21 THEN 'pays a card' ELSE 'amount and date' END AS evidence FROM
    (SELECT *, count(*) OVER (PARTITION BY out_txn_id) AS of_out, count(*) OVER (PARTITION BY in_txn_id) AS of_in FROM ({PAIRS}) WHERE days_apart <= 4 OR (pays_card AND days_apart <= 21))
    WHERE of_out = 1 AND of_in = 1)"""


@query("SELECT evidence, count(*) AS n_links, CAST(sum(amount) AS BIGINT) AS value_minor FROM sure GROUP BY 1", CTES, SURE)
def agg_13_links_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the links of legs that have one candidate each, which any order of settling makes."""
    return transfers.by_evidence(derived.sure_links(ledger(spark, sf_dir)))


@over_ledger()
def trf_05_ambiguous(l: Ledger) -> DataFrame:  # noqa: E741
    legs = transfers.legs_of(l)
    return transfers.ambiguous(legs, transfers.find_transfers(legs))


@query("""SELECT out_txn_id, in_txn_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT out_txn_id, in_txn_id, 1 AS now FROM sure)
    FULL JOIN (SELECT out_txn_id, in_txn_id, 1 AS was FROM transfer_link WHERE origin = 'auto' AND in_txn_id IS NOT NULL) USING (out_txn_id, in_txn_id)""", CTES, SURE)
def set_02_rerun_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the links of legs that have one candidate each, against those stored."""
    l = ledger(spark, sf_dir)  # noqa: E741
    return transfers.rerun_diff(derived.sure_links(l), l.transfer_link)


WORTH = """SELECT "on", CAST(sum(sum(change)) OVER (ORDER BY "on") AS BIGINT) AS worth_minor, CAST(sum(sum(new)) OVER (ORDER BY "on") AS BIGINT) AS accounts_known FROM
    (SELECT period_end AS "on", closing_minor - coalesce(lag(closing_minor) OVER a, 0) AS change, CASE WHEN lag(closing_minor) OVER a IS NULL THEN 1 ELSE 0 END AS new
     FROM balance WINDOW a AS (PARTITION BY account_id ORDER BY period_end)) GROUP BY "on" """


@over_ledger(WORTH)
def nw_02_net_worth(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.net_worth(l.balance)


@over_ledger(f"""SELECT strftime("on", '%Y-%m') AS month, max("on") AS "on", arg_max(worth_minor, "on") AS worth_minor FROM ({WORTH}) GROUP BY 1""")
def win_04_month_ends(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.month_ends(statements.net_worth(l.balance))


@over_ledger(f"""SELECT a AS first_minor, b AS last_minor, b - a AS change_minor, CASE WHEN a > 0 THEN round_even((b - a) / CAST(a AS DOUBLE), 4) END AS share
    FROM (SELECT arg_min(worth_minor, "on") AS a, arg_max(worth_minor, "on") AS b FROM ({WORTH}))""")
def nw_03_change(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.worth_change(statements.net_worth(l.balance))


DRIFTS = f"""SELECT account_id, 'continuity' AS kind, period_end AS until, prev_closing AS expected_minor, opening_minor AS actual_minor
    FROM (SELECT *, lag(closing_minor) OVER w AS prev_closing FROM balance WINDOW w AS (PARTITION BY account_id ORDER BY period_end)) WHERE opening_minor <> prev_closing
    UNION ALL SELECT account_id, 'movement', period_end, closing_minor - prev_closing, coalesce((SELECT CAST(sum(moved_minor) AS BIGINT) FROM ({MOVEMENT}) m
        WHERE m.account_id = s.account_id AND m.day > s.prev_end AND m.day <= s.period_end), 0) AS actual
    FROM (SELECT *, lag(closing_minor) OVER w AS prev_closing, lag(period_end) OVER w AS prev_end FROM balance WINDOW w AS (PARTITION BY account_id ORDER BY period_end)) s
    WHERE prev_closing IS NOT NULL AND closing_minor - prev_closing <> coalesce((SELECT CAST(sum(moved_minor) AS BIGINT) FROM ({MOVEMENT}) m
        WHERE m.account_id = s.account_id AND m.day > s.prev_end AND m.day <= s.period_end), 0)"""


@over_ledger(DRIFTS)
def rec_01_drifts(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.drifts(l.balance, spending.daily_movement(l))


@over_ledger(f"SELECT count(*) = 0 AS is_clean, count(*) FILTER (kind = 'continuity') AS n_continuity, count(*) FILTER (kind = 'movement') AS n_movement FROM ({DRIFTS})")
def rec_05_clean(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.clean(statements.drifts(l.balance, spending.daily_movement(l)))


@over_ledger("""SELECT b.document_id AS doc, b.account_id, CASE WHEN b.opening_minor + coalesce(r.total, 0) = b.closing_minor THEN 'imported' ELSE 'quarantined' END AS status,
    b.opening_minor + coalesce(r.total, 0) - b.closing_minor AS difference FROM balance b LEFT JOIN (SELECT b.document_id, CAST(sum(t.amount_minor) AS BIGINT) AS total FROM txn t
    JOIN balance b ON b.account_id = t.account_id AND t.posted_date BETWEEN b.period_start AND b.period_end GROUP BY 1) r USING (document_id)""")
def val_01_validate(l: Ledger) -> DataFrame:  # noqa: E741
    checked = statements.validate(*derived.statement_tables(l))
    return checked.select("doc", "account_id", "status", "difference")


@over_ledger("""SELECT CAST(t.document_id AS BIGINT) AS doc, t.account_id, t.txn_id AS pos, t.amount_minor,
    CASE WHEN abs(t.amount_minor) = abs(d) THEN 'row equals difference' ELSE 'row equals half of it' END AS hint FROM txn t JOIN
    (SELECT b.document_id, arg_min(t.amount_minor, t.txn_id) * CASE WHEN b.account_id % 2 = 0 THEN 1 ELSE 2 END + CASE WHEN b.account_id % 17 = 0 AND b.document_id % 1000 = 2 THEN 100 ELSE 0 END AS d
     FROM balance b JOIN txn t USING (document_id) GROUP BY b.document_id, b.account_id) USING (document_id)
    WHERE d <> 0 AND (abs(t.amount_minor) = abs(d) OR abs(t.amount_minor) * 2 = abs(d))""")
def val_09_hints(l: Ledger) -> DataFrame:  # noqa: E741
    """Statements that fail: their closings are off by their first row, or by twice that."""
    declared, rows = derived.statement_tables(l)
    first = rows.groupBy("doc").agg((F.min_by("amount_minor", "pos") * F.when(F.min("account_id") % 2 == 0, 1).otherwise(2)).alias("off"))
    off = declared.join(first, "doc").withColumn("closing_minor", F.col("closing_minor") + F.col("off")).drop("off")
    return statements.difference_hints(statements.validate(off, rows), rows)


WHOLE = """SELECT doc, account_id, CASE WHEN max(off) OVER w = 1 OR any_value(declared) OVER w <> sum(n) OVER w THEN 'quarantined' ELSE 'imported_unverified' END AS status, off = 1 AS has_wrong_total FROM
    (SELECT b.account_id // 4 AS doc, b.account_id, count(*) AS n, CASE WHEN b.account_id % 9 = 0 THEN 1 ELSE 0 END AS off, 2 * ((sum(count(*)) OVER (PARTITION BY b.account_id // 4) + 1) // 2) AS declared
     FROM txn b GROUP BY 1, 2) WINDOW w AS (PARTITION BY doc)"""


@over_ledger(WHOLE)
def val_07_whole_documents(l: Ledger) -> DataFrame:  # noqa: E741
    """Documents of four accounts without balances: totals that are declared wrongly for some, and a count that is off where it is odd."""
    declared, rows = derived.combined_statements(l)
    checked = statements.validate(declared, rows)
    return checked.select("doc", "account_id", "status", F.array_contains("failed", "declared_totals").alias("has_wrong_total"))


OPENS = dt.date(2024, 1, 17)
#: Net worth of a window: only balances that end in it are known.
IN_WINDOW = WORTH.replace("FROM balance WINDOW", f"FROM balance WHERE NOT (account_id % 3 = 0 AND period_end > DATE '2024-01-14') AND period_end >= DATE '{OPENS}' AND closing_minor IS NOT NULL WINDOW")


@over_ledger(f"""SELECT max("on") AS "on", arg_max(worth_minor, "on") AS worth_minor, arg_max(accounts_known, "on") AS accounts_known FROM ({WORTH}) GROUP BY date_trunc('month', "on")""")
def nw_04_growth(l: Ledger) -> DataFrame:  # noqa: E741
    """By month, over all balances of all accounts."""
    return statements.growth(l.balance)


@over_ledger(IN_WINDOW)
def nw_04_growth_by_statement(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.growth(derived.closing_early(l.balance), OPENS, every="statement")


KEYED = """keyed AS (SELECT *, row_number() OVER (PARTITION BY doc, account_key, posted_date, amount_minor, description_norm ORDER BY txn_id) - 1 AS seq FROM
    (SELECT txn_id, CAST(account_id AS VARCHAR) AS doc, lpad(CAST(account_id AS VARCHAR), 10, '0') || '||SGD' AS account_key, posted_date, amount_minor,
     split_part(counterparty_norm, ' SHOP', 1) AS description_norm FROM txn)),
hashed AS (SELECT txn_id, doc, CAST(seq AS INTEGER) AS seq, sha256(concat_ws(chr(31), account_key, strftime(posted_date, '%Y-%m-%d'), CAST(amount_minor AS VARCHAR), description_norm, CAST(seq AS VARCHAR))) AS dedupe_key FROM keyed)"""


@query("SELECT * FROM hashed", CTES, KEYED)
def win_02_dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.keyed_rows(ledger(spark, sf_dir))


@query("SELECT count(*) AS n_new, count(DISTINCT dedupe_key) AS n_keys FROM hashed WHERE dedupe_key NOT IN (SELECT dedupe_key FROM hashed JOIN hidden USING (txn_id))", CTES, KEYED)
def set_04_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert beside a ledger that holds the hidden rows already."""
    l = ledger(spark, sf_dir)  # noqa: E741
    rows = derived.keyed_rows(l)
    fresh = identity.complement(rows, rows.join(l.hidden, "txn_id", "left_semi"))
    return fresh.agg(F.count(F.lit(1)).alias("n_new"), F.count_distinct("dedupe_key").alias("n_keys"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc, sha256(concat_ws(chr(31), o_orderpriority, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d'), strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d'),
    coalesce((SELECT string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) FROM lineitem WHERE l_orderkey = o_orderkey), ''))) AS statement_key
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def str_13_statement_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.statement_key(derived.statement_refs(spark, sf_dir))


AMOUNTS = """SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS minor,
    CASE WHEN o_orderstatus = 'F' THEN 'USD' ELSE 'SGD' END AS currency FROM orders"""


@query(AMOUNTS)
def mny_01_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed amounts of orders in three shapes, read back."""
    printed = derived.printed_amounts(spark, sf_dir)
    return printed.select("o_orderkey", money.parse_amount(F.col("printed"), F.lit("SGD")).alias("a")).select("o_orderkey", "a.*")


@query("""SELECT o_orderkey, (SELECT g FROM (VALUES (100), (500), (1000), (2000), (5000), (10000), (30000), (50000), (100000), (1000000), (5000000)) t(g)
    ORDER BY abs(g - abs(CAST(round(o_totalprice) AS BIGINT))), g DESC LIMIT 1) AS x FROM orders""")
def mny_05_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", money.gate(F.round("o_totalprice").cast("long")).alias("x"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS named, CAST(o_orderdate AS DATE) AS numeric, CAST(o_orderdate AS DATE) AS in_period, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS month_before FROM orders")
def dat_01_statement_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed dates of orders, read back: with month names, with digits, and without a year."""
    p = derived.printed_dates(spark, sf_dir)
    return p.select(
        "o_orderkey", dates.full_date(F.col("named")).alias("named"), dates.numeric_date(F.col("numeric")).alias("numeric"),
        dates.day_in_period(F.col("yearless"), F.col("start"), F.col("end"), look_back=95).alias("in_period"), dates.month_before(F.col("day")).alias("month_before"),
    )


@query("""SELECT p_partkey, upper(p_name) || ' ' || upper(replace(p_brand, '#', ' ')) AS description_norm, upper(p_name) || ' ' || upper(replace(p_brand, '#', ' ')) AS counterparty FROM part""")
def str_02_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorated descriptions of parts come back to their names."""
    printed = derived.printed_descriptions(spark, sf_dir)
    normal = printed.select("p_partkey", text.normalise_description(F.col("plain"), fold=False).alias("description_norm"), text.normalise_description(F.col("decorated"), fold=False).alias("d"))
    return normal.select("p_partkey", "description_norm", text.normalise_counterparty(F.col("d")).alias("counterparty"))


@query("SELECT o_orderkey, right(lpad(CAST(o_orderkey AS VARCHAR), 16, '4'), 4) AS tail FROM orders")
def str_04_card_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.printed_cards(spark, sf_dir).select("o_orderkey", F.get(transfers.card_tails(F.col("line")), 0).alias("tail"))


SPENT = "spent AS (SELECT upper(p_name) AS name, -CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor FROM lineitem JOIN part ON p_partkey = l_partkey)"
RULE_ROWS = ", ".join(f"('{p}', '{c}', {w})" for p, c, w in derived.PART_RULES)
JUDGED = f"""rules AS (SELECT * FROM (VALUES {RULE_ROWS}) r(pattern, category, weight)), names AS (SELECT DISTINCT name FROM spent),
hits AS (SELECT name, category, rank() OVER (PARTITION BY name ORDER BY weight DESC, length(pattern) DESC) AS rk FROM names JOIN rules ON regexp_matches(name, '(?i)' || pattern)),
best AS (SELECT name, min(category) AS lo, max(category) AS hi FROM hits WHERE rk = 1 GROUP BY 1),
judged AS (SELECT name, CASE WHEN lo = hi THEN lo ELSE 'Others' END AS category, coalesce(lo = hi, false) AS decided, coalesce(lo <> hi, false) AS contested FROM names LEFT JOIN best USING (name))"""


@query("SELECT * FROM judged", SPENT, JUDGED)
def cat_01_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derived.spent(spark, sf_dir).select("name").distinct()
    return categories.categorise(names, derived.part_rules(spark))


COUNTERPARTIES = """spent AS (SELECT CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN 'PayNow to ' || part WHEN 1 THEN 'atm ' || part WHEN 2 THEN chr(32) || chr(9) || part || '  ' WHEN 3 THEN part || ' 123-4567890'
    WHEN 4 THEN CASE WHEN l_linenumber % 2 = 0 THEN '  ' END WHEN 5 THEN 'Cash Withdrawal' ELSE part END AS name, -CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor
    FROM lineitem JOIN (SELECT p_partkey, upper(p_name) AS part FROM part) ON p_partkey = l_partkey)"""
#: The same without white space around names, or with an empty name for none.
STRIPPED = COUNTERPARTIES.replace("spent AS (SELECT", "raw AS (SELECT") + r", spent AS (SELECT regexp_replace(name, '^\s+|\s+$', '', 'g') AS name, amount_minor FROM raw)"
NAMED = COUNTERPARTIES.replace("spent AS (SELECT", "raw AS (SELECT") + ", spent AS (SELECT coalesce(name, '') AS name, amount_minor FROM raw)"
#: Whom nobody is asked about. Persons and accounts by what their names hold, conduits by the first word or the whole name.
NOBODY = r"""(name = '' OR regexp_matches(name, '(?i)\b(PAYNOW|PAYLAH|FAST\s+PAYMENT|FUNDS?\s+TRANSFER|TRANSFER\s+(TO|FROM)|INCOMING|OUTGOING|TO:|FROM:|MR|MRS|MS|MDM)\b')
    OR regexp_matches(name, '\b\d[\d\s-]{5,}\d\b') OR list_contains(conduits, split_part(upper(name), ' ', 1)) OR list_contains(conduits, upper(name)))"""
CONDUITS = """(SELECT ['PAYLAH', 'PAYNOW', 'GRABPAY', 'SHOPEEPAY', 'FAVEPAY', 'ALIPAY', 'WECHATPAY', 'LAZADA', 'SHOPEE', 'AMAZON', 'QOO10', 'CAROUSELL', 'ATM', 'CASH WITHDRAWAL', 'CASH', 'NETS', 'EZ-LINK', 'EZLINK'] AS conduits)"""


@query(f"""SELECT name, count(*) AS n_rows, CAST(sum(abs(amount_minor)) AS BIGINT) AS value_minor, any_value(contested) AS contested FROM spent JOIN judged USING (name) CROSS JOIN {CONDUITS}
    WHERE NOT decided AND NOT {NOBODY} GROUP BY 1 ORDER BY value_minor DESC, name LIMIT 500""", STRIPPED, JUDGED)
def cat_09_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of names among which are persons, accounts, conduits and none."""
    return categories.review_queue(derived.counterparties(spark, sf_dir), derived.part_rules(spark))


@query("""SELECT d AS decided, c AS contested, n - d - c AS unmatched, n AS n_rows, round_even(d / CAST(n AS DOUBLE), 4) AS share FROM
    (SELECT count(*) FILTER (decided) AS d, count(*) FILTER (contested) AS c, count(*) AS n FROM spent JOIN judged USING (name))""", NAMED, JUDGED)
def agg_15_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.coverage(derived.counterparties(spark, sf_dir), derived.part_rules(spark))


@query("SELECT name, count(*) AS n_rows, CAST(sum(abs(amount_minor)) AS BIGINT) AS value_minor FROM spent JOIN judged USING (name) WHERE NOT decided AND NOT contested GROUP BY 1 ORDER BY n_rows DESC, name LIMIT 20", NAMED, JUDGED)
def top_06_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.gaps(derived.counterparties(spark, sf_dir), derived.part_rules(spark))


@query("SELECT name, m AS median FROM (SELECT name, abs(amount_minor) AS m, row_number() OVER (PARTITION BY name ORDER BY abs(amount_minor)) - 1 AS pos, count(*) OVER (PARTITION BY name) // 2 AS middle FROM spent) WHERE pos = middle", SPENT)
def agg_16_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.spent(spark, sf_dir).select("name", F.abs("amount_minor").alias("m"))
    return categories.upper_median_by(rows, "name", "m")


@query(f"""SELECT name, n_rows, (SELECT g FROM (VALUES (100), (500), (1000), (2000), (5000), (10000), (30000), (50000), (100000), (1000000), (5000000)) t(g) ORDER BY abs(g - m), g DESC LIMIT 1) AS typical_minor,
    value_minor, suggested, left('POS ' || upper(name) || ' TERMINAL #', 120) AS sample FROM
    (SELECT name, count(*) AS n_rows, CAST(sum(abs(amount_minor)) AS BIGINT) AS value_minor, list_sort(list(abs(amount_minor)))[count(*) // 2 + 1] AS m FROM spent CROSS JOIN {CONDUITS} WHERE trim(name) = name AND NOT {NOBODY} GROUP BY 1)
    LEFT JOIN (SELECT name, CASE WHEN decided THEN category END AS suggested FROM judged) USING (name)
    WHERE name NOT IN (SELECT name FROM spent WHERE regexp_matches(name, '(?i)\\bSMALL\\b'))""", COUNTERPARTIES, JUDGED)
def cat_10_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a weight settle; all suggest. Names have one line each."""
    rows = derived.counterparties(spark, sf_dir).withColumn("description", F.concat(F.lit("pos "), "name", F.lit(" terminal 7781")))
    rules = derived.part_rules(spark)
    return categories.propose(rows.where("trim(name) = name"), rules.where("weight > 0"), rules, fold=False)


VOTES = "votes AS (SELECT DISTINCT event_type AS model, 'SHOP ' || CAST(k AS VARCHAR) AS name, CASE WHEN amount_minor % 3 = 0 THEN 'Dining' WHEN amount_minor % 3 = 1 OR amount_minor % 3 = -2 THEN 'Grocery' ELSE 'Nonsense' END AS category FROM (SELECT event_type, k, min(amount_minor) AS amount_minor FROM ev GROUP BY 1, 2))"


@query("""SELECT name, arg_min(category, struct_pack(a := -agreed, b := category)) AS category, max(agreed) AS agreed, CAST(sum(agreed) AS BIGINT) AS answered, max(agreed) <> sum(agreed) AS needs_review
    FROM (SELECT name, category, count(*) AS agreed FROM votes WHERE category <> 'Nonsense' GROUP BY 1, 2) GROUP BY 1""", CTES, VOTES)
def cat_11_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.consolidate(derived.model_votes(spark, sf_dir)).drop("dissent")


SHOPS = ", ".join(f"('{p}', '{c}', {w})" for p, c, w in derived.SHOP_RULES)


@query(f"""SELECT txn_id, category, 'human' AS source FROM enrichment WHERE source = 'human' UNION ALL SELECT txn_id, lo, 'rule' FROM
    (SELECT txn_id, min(category) AS lo, max(category) AS hi FROM (SELECT txn_id, category, rank() OVER (PARTITION BY txn_id ORDER BY weight DESC, length(pattern) DESC) AS rk FROM txn
     JOIN (VALUES {SHOPS}) r(pattern, category, weight) ON regexp_matches(counterparty_norm, '(?i)' || pattern)
     WHERE amount_minor < 0 AND txn_id NOT IN (SELECT out_txn_id FROM transfer_link) AND txn_id NOT IN (SELECT in_txn_id FROM transfer_link WHERE in_txn_id IS NOT NULL)
     AND txn_id NOT IN (SELECT txn_id FROM enrichment WHERE source = 'human')) WHERE rk = 1 GROUP BY 1) WHERE lo = hi""", CTES)
def cat_04_apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ledger(spark, sf_dir)  # noqa: E741
    names = spending.targets(l).select("txn_id", F.col("counterparty_norm").alias("name"))
    return categories.apply_rules(names, l.enrichment, derived.rules_of(spark, derived.SHOP_RULES))


@over_ledger("""SELECT category, CAST(sum(r) AS BIGINT) AS n_rules, CAST(sum(t) AS BIGINT) AS n_txns FROM (SELECT category, 0 AS r, count(*) AS t FROM enrichment GROUP BY 1
    UNION ALL SELECT category, count(*), 0 FROM (VALUES """ + RULE_ROWS + """) v(pattern, category, weight) GROUP BY 1) GROUP BY 1""")
def agg_14_category_usage(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.category_usage(l, derived.part_rules(l.txn.sparkSession))


OCC = """occ AS (SELECT c_custkey * 100 + i AS txn_id, 'PAYEE ' || CAST(c_custkey AS VARCHAR) AS merchant,
    DATE '2020-01-01' + CAST(c_custkey % 28 + i * [7, 14, 30, 91, 47][c_custkey % 5 + 1] + ((c_custkey * (i + 1)) % 3 - 1) AS INTEGER) AS posted_date,
    -CAST(1000 + c_custkey % 500 + CASE WHEN i >= 6 AND c_custkey % 4 = 0 THEN 900 ELSE 0 END AS BIGINT) AS amount_minor FROM customer, range(10) t(i))"""


REGULAR = """SELECT merchant, -amount_minor AS centre_minor, n_rows, label AS period_label, first_seen, last_seen FROM (SELECT *, CASE WHEN abs(s - n * 7) <= n THEN 'weekly' WHEN abs(s - n * 14) <= 2 * n THEN 'fortnightly'
    WHEN abs(s - n * 30) <= 3 * n THEN 'monthly' WHEN abs(s - n * 91) <= 5 * n THEN 'quarterly' WHEN abs(s - n * 365) <= 7 * n THEN 'yearly' END AS label FROM
    (SELECT merchant, amount_minor, count(*) AS n_rows, count(gap) AS n, sum(gap) AS s, sum(gap * gap) AS q, min(gap) AS least, min(posted_date) AS first_seen, max(posted_date) AS last_seen FROM
    (SELECT *, date_diff('day', lag(posted_date) OVER (PARTITION BY merchant, amount_minor ORDER BY posted_date, txn_id), posted_date) AS gap FROM occ) GROUP BY 1, 2)
    WHERE n_rows >= 3 AND least > 0 AND (n * q - s * s) * 10000 < s * s * 225) WHERE label IS NOT NULL"""


@query(REGULAR, OCC)
def rcr_04_regular_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrence.regular_groups(derived.occurrences(spark, sf_dir))


@query()
def rcr_01_find_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential within a merchant: tested against hand-computed cases and in any order of rows."""
    return recurrence.find_series(derived.occurrences(spark, sf_dir))


STATUS = f"""SELECT merchant, centre_minor, period_label, overdue, lapsed, due, monthly_minor FROM (SELECT *, late > slack AND late <= 2 * days AS overdue, late > 2 * days AS lapsed,
    late <= 0 AND late >= -7 AS due, CAST(round_even(centre_minor * CASE period_label WHEN 'weekly' THEN 52 / 12.0 WHEN 'fortnightly' THEN 26 / 12.0 WHEN 'monthly' THEN 1.0 WHEN 'quarterly' THEN 1 / 3.0 ELSE 1 / 12.0 END, 0) AS BIGINT) AS monthly_minor
    FROM (SELECT r.*, days, slack, date_diff('day', last_seen + days, DATE '2021-01-01') AS late FROM ({REGULAR}) r
    JOIN (VALUES ('weekly', 7, 1), ('fortnightly', 14, 2), ('monthly', 30, 3), ('quarterly', 91, 5), ('yearly', 365, 7)) p(period_label, days, slack) USING (period_label)))"""


@query(STATUS, OCC)
def rcr_09_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the series that stand in windows alone."""
    series = recurrence.with_expected(recurrence.regular_groups(derived.occurrences(spark, sf_dir)))
    return recurrence.status(series, dt.date(2021, 1, 1)).select("merchant", "centre_minor", "period_label", "overdue", "lapsed", "due", "monthly_minor")


@query(f"SELECT count(*) AS n_series, CAST(coalesce(sum(monthly_minor), 0) AS BIGINT) AS monthly_minor FROM ({STATUS}) WHERE NOT lapsed", OCC)
def rcr_13_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = recurrence.with_expected(recurrence.regular_groups(derived.occurrences(spark, sf_dir)))
    return recurrence.commitment(recurrence.status(series, dt.date(2021, 1, 1)))


@query()
def rcr_12_price_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential as rcr_01_find_series is."""
    return recurrence.price_rises(recurrence.find_series(derived.occurrences(spark, sf_dir)))


PLACED = """placed AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, 1 AS page, l_linenumber, 100.0 + l_linenumber * 28 + l_partkey % 3 AS top, unnest([
    {'x0': 53.0, 'text': strftime(l_shipdate, '%d/%m/%Y')}, {'x0': 146.0, 'text': l_returnflag}, {'x0': 170.0, 'text': l_linestatus}, {'x0': 475.0, 'text': format('{:,.2f}', l_extendedprice)}]) AS w FROM lineitem)"""


@query("""SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc ORDER BY l_linenumber) - 1 AS INTEGER) AS line, top, text FROM (SELECT doc, page, l_linenumber, min(top) AS top,
    string_agg(w.text, ' ' ORDER BY w.x0, w.text) AS text FROM placed GROUP BY 1, 2, 3)""", PLACED)
def src_04_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words placed on pages, read as lines."""
    return geometry.lines(derived.placed_words(spark, sf_dir))


@query("""SELECT doc, page, top, CASE WHEN w.x0 < 140 THEN 'date' WHEN w.x0 < 360 THEN 'text' ELSE 'amount' END AS "column", string_agg(w.text, ' ' ORDER BY w.x0, w.text) AS text FROM placed GROUP BY 1, 2, 3, 4""", PLACED)
def src_08_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of those lines by half-open bands."""
    return geometry.cells(derived.placed_words(spark, sf_dir), derived.BANDS)


@query("""SELECT page_id, n_words, label_key FROM (SELECT page_id, count(*) AS n_words, sha1(string_agg(DISTINCT label, '|' ORDER BY label)) AS label_key FROM
    (SELECT page_id, regexp_replace(lower(unnest(string_split(url, '/'))), '[0-9]+', '#', 'g') AS label FROM pages) WHERE label <> '' GROUP BY 1)""")
def src_18_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.label_fingerprints(derived.page_labels(spark, sf_dir))


@query("""SELECT doc, CAST(pos AS BIGINT) AS pos, page, description FROM (SELECT CAST(l_orderkey AS VARCHAR) AS doc, 1 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos,
    CASE WHEN l_linenumber % 3 = 0 THEN 'lead ' || CAST(l_linenumber AS VARCHAR) || ' ' ELSE '' END || 'row ' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' more ' || CAST(l_linenumber AS VARCHAR) ELSE '' END AS description
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def src_09_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows that lines above lead into and lines below go on with; lines too far off belong to none."""
    return layout.rows_of(derived.printed_lines(spark, sf_dir), gap=9.0).select("doc", "pos", "page", "description")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc, 1 AS pos, '01/06 ORDER ' || CAST(o_orderkey AS VARCHAR) AS description, format('{:,.2f}', o_totalprice) AS printed,
    CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS sign FROM orders""")
def src_07_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as statements of one row under a header whose columns are elsewhere on each, read by a layout."""
    rows = layout.statement_rows(derived.printed_statements(spark, sf_dir), layout.DEPOSIT)
    return layout.signed_amounts(rows, layout.DEPOSIT).select("doc", F.col("pos").cast("int").alias("pos"), "description", "printed", "sign")


@over_ledger(f"SELECT count(DISTINCT counterparty_norm) AS n_merchants, count(DISTINCT account_id) AS n_accounts FROM base WHERE {OUT}")
def agg_18_distinct_counts(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.distinct_counts(l)


@over_ledger(nearest_inflows("true", "(contains(upper(counterparty_norm), 'SIGNUP SHOP 4') OR contains(upper(description_raw), 'SIGNUP SHOP 4'))", 3))
def pbk_02_search(l: Ledger) -> DataFrame:  # noqa: E741
    """The three nearest inflows of a name for each charge, however many days away."""
    return spending.payback_candidates(l, some_charges(l), text="signup shop 4", limit=3).withColumn("days_apart", F.col("days_apart").cast("long"))


@query("""SELECT o_custkey AS account_id, 'XXXX-XXXX-XXXX-' || right(lpad(CAST(o_orderkey AS VARCHAR), 16, '4'), 4) AS number, min(CAST(o_orderdate AS DATE)) AS first_seen, max(CAST(o_orderdate AS DATE)) AS last_seen
    FROM orders GROUP BY 1, 2""")
def win_12_card_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards that customers' orders name, and since and until when; odd orders were stored before."""
    seen = derived.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("seen"))
    lines = derived.printed_cards(spark, sf_dir).join(dealt_join(seen), "o_orderkey")
    rows = lines.select(F.col("o_custkey").alias("account_id"), F.explode(text.card_numbers(F.col("line"))).alias("number"), "seen", "o_orderkey")
    return identity.card_sightings(rows.where("o_orderkey % 2 = 0"), identity.card_sightings(rows.where("o_orderkey % 2 = 1")))


@query("""SELECT p_partkey AS rule_id, '^' || p_name AS pattern, 'Renamed ' || split_part(p_type, ' ', 1) AS category, p_size AS weight FROM part""")
def jn_03_rules_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules whose categories, kinds of part, have been renamed since."""
    part = derived.read(spark, sf_dir, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1)))
    kinds = part.select("kind").distinct().select(F.xxhash64("kind").alias("category_id"), F.concat(F.lit("Renamed "), "kind").alias("name"))
    rules = part.select(
        F.col("p_partkey").alias("rule_id"), F.concat(F.lit("^"), "p_name").alias("pattern"), F.xxhash64("kind").alias("category_id"), F.col("p_size").alias("weight"),
        F.lit(None).cast("string").alias("literal"), F.lit("seed").alias("note"),
    )
    return categories.named_rules(rules, kinds).select("rule_id", "pattern", "category", "weight")


@query("""SELECT account_id AS doc, account_id, CASE WHEN failed <> '' THEN 'quarantined' WHEN account_id % 3 = 0 THEN 'imported_unverified' ELSE 'imported' END AS status, failed FROM
    (SELECT a.account_id, concat_ws(',', CASE WHEN a.account_id % 3 <> 0 AND a.account_id % 11 = 0 THEN 'balance' END, CASE WHEN last > DATE '2024-01-28' THEN 'dates' END,
        CASE WHEN NOT in_order THEN 'order' END, CASE WHEN big > 20000 THEN 'ceiling' END) AS failed FROM
        (SELECT account_id, max(abs(amount_minor)) AS big, max(posted_date) AS last FROM txn GROUP BY 1) a JOIN
        (SELECT account_id, bool_and(ok) AS in_order FROM (SELECT account_id, section, coalesce(NOT (max(step) > 0 AND min(step) < 0), true) AS ok FROM
            (SELECT account_id, section, sign(date_diff('day', lag(posted_date) OVER (PARTITION BY account_id, section ORDER BY pos), posted_date)) AS step FROM
                (SELECT *, txn_id % 2 AS section, CASE WHEN account_id % 2 = 0 THEN txn_id ELSE (txn_id * 7919) % 10007 * 100000000 + txn_id END AS pos FROM txn)) GROUP BY 1, 2) GROUP BY 1) o USING (account_id))""", CTES)
def val_02_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each account: some without balances, some off by one, some with rows out of order, late or too large."""
    declared, rows = derived.account_statements(ledger(spark, sf_dir))
    checked = statements.validate(declared, rows, ceiling=20_000)
    return checked.select("doc", "account_id", "status", F.array_join("failed", ",").alias("failed"))


@over_ledger("SELECT b.document_id, b.account_id, institution, right(account_ref, 4) AS ref_tail, kind, period_end, closing_minor FROM balance b JOIN account USING (account_id)")
def jn_08_balances(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.balance_listing(l.balance, l.account)


@query("SELECT dedupe_key, CASE WHEN txn_id % 3 <> 0 THEN 'only_here' ELSE 'only_there' END AS side FROM hashed WHERE (txn_id % 3 <> 0) <> (txn_id % 5 <> 0)", CTES, KEYED)
def set_03_content_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of one ledger, each of which lacks some rows."""
    rows = derived.keyed_rows(ledger(spark, sf_dir))
    return identity.content_compare(rows.where("txn_id % 3 <> 0"), rows.where("txn_id % 5 <> 0"))


@over_ledger("SELECT account_id, institution || ' ' || account_ref || CASE WHEN kind = 'card' THEN '/card' ELSE '' END AS label FROM account")
def str_15_labels(l: Ledger) -> DataFrame:  # noqa: E741
    label = F.when(F.col("kind") == "card", "card").otherwise("")
    return l.account.select("account_id", text.account_label(F.col("institution"), F.col("account_ref"), label).alias("label"))


@over_ledger("SELECT count(*) AS n_rows, CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS total_minor FROM txn WHERE txn_id IN (SELECT out_txn_id FROM transfer_link WHERE origin = 'manual')")
def agg_12_marked_total(l: Ledger) -> DataFrame:  # noqa: E741
    return spending.marked_total(l)


@over_ledger(f"""SELECT institution, count(*) AS n_documents, count(*) FILTER (status = 'quarantined') AS n_quarantined FROM
    (SELECT DISTINCT institution, doc, status FROM ({WHOLE}) JOIN account USING (account_id)) GROUP BY 1""")
def agg_09_documents(l: Ledger) -> DataFrame:  # noqa: E741
    return statements.status_counts(statements.validate(*derived.combined_statements(l)), l.account)


#: What printed orders are worth: of each, whether it is known, can be read, adds up, or is a statement that an earlier one was already.
PRINTED = """printed AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown_layout' WHEN o_orderkey % 13 = 0 THEN 'parse_failed' WHEN o_orderkey % 7 = 0 THEN 'validation_failed' ELSE 'imported' END AS fate,
    '500-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS ref, date_trunc('month', CAST(o_orderdate AS DATE)) AS start FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query("SELECT doc, fate FROM printed", PRINTED)
def rtr_05_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as statements of two forms: routed, read, checked and compared with what is held."""
    return derived.assessed(spark, sf_dir).fates.select("doc", "fate")


@query("""SELECT doc, ref || '||SGD' AS account_key, CAST(start AS DATE) + CAST(l_linenumber AS INTEGER) AS posted_date, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor,
    'PART ' || CAST(l_partkey AS VARCHAR) || ' LINE ' || CAST(l_linenumber AS VARCHAR) AS description_norm FROM printed JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag FROM lineitem) ON CAST(l_orderkey AS VARCHAR) = doc WHERE fate = 'imported'""", PRINTED)
def snk_01_imported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions that those documents bring to a ledger."""
    return derived.assessed(spark, sf_dir).tables["txn"].select("doc", "account_key", "posted_date", "amount_minor", "description_norm")


@query(r"""SELECT '^' || regexp_replace(name, '([^A-Za-z0-9_])', '\\\1', 'g') || '$' AS pattern, any_value(category) AS category, 0 AS weight, name AS literal FROM votes WHERE category <> 'Nonsense'
    GROUP BY name HAVING count(DISTINCT category) = 1 AND any_value(category) <> 'Others'""", CTES, VOTES)
def cat_12_consensus_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for the shops that all kinds of event, as models, put in one category."""
    return categories.consensus_rules(categories.consolidate(derived.model_votes(spark, sf_dir)))


@query("SELECT o_orderkey, CAST(m // 100 AS VARCHAR) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') || '0' AS shown FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS m FROM orders)")
def mny_03_from_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = derived.read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", money.from_minor(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit("SGD")).cast("string").alias("shown"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + 30 AS last_day FROM orders")
def dat_05_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed periods of orders, with three kinds of dashes, read back."""
    day, dash = F.to_date("o_orderdate"), F.element_at(F.array(F.lit("-"), F.lit("\u2013"), F.lit("\u2014")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    printed = F.concat_ws(" ", F.date_format(day, "d MMM yyyy"), dash, F.date_format(F.date_add(day, 30), "d MMMM yyyy"))
    found = dates.period(printed)
    return derived.read(spark, sf_dir, "orders").select("o_orderkey", found["start"].alias("first_day"), found["end"].alias("last_day"))


@query("""SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS sha256, key AS statement_key, CASE WHEN o_orderkey % 6 = 0 THEN 'known' WHEN NOT EXISTS (SELECT 1 FROM k s WHERE s.o_orderkey % 3 = 0 AND s.key = n.key) THEN 'new'
    WHEN EXISTS (SELECT 1 FROM k s WHERE s.o_orderkey % 3 = 0 AND s.key = n.key AND s.o_orderpriority = n.o_orderpriority) THEN 'duplicate' ELSE 'conflicting' END AS fate FROM k n""",
    "k AS (SELECT *, CAST(o_custkey AS VARCHAR) || strftime(CAST(o_orderdate AS DATE), ' %Y') AS key FROM orders)")
def wrt_01_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements of a customer and year, their priorities as contents; every third is held, half of these under another file."""
    o = derived.read(spark, sf_dir, "orders").withColumn("key", F.concat_ws(" ", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy")))
    named = lambda p: F.concat(p, F.col("o_orderkey").cast("string")).alias("sha256")
    rest = ["sha256", F.col("key").alias("statement_key"), F.col("o_orderpriority").alias("content")]
    held = o.where("o_orderkey % 3 = 0").withColumn("sha256", named(F.when(F.col("o_orderkey") % 2 == 0, "f").otherwise("g"))).select(*rest)
    return identity.arrival(o.withColumn("sha256", named(F.lit("f"))).select(*rest), held)


@query("""SELECT account_key, min(institution) AS institution, min(kind) AS kind FROM (SELECT CAST(c_custkey % 500 AS VARCHAR) AS account_key, c_mktsegment AS institution, CASE WHEN c_acctbal < 0 THEN 'card' ELSE 'deposit' END AS kind FROM customer)
    WHERE CAST(account_key AS INTEGER) % 3 <> 0 GROUP BY 1""")
def wrt_03_new_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts that arrive more than once; every third is stored."""
    c = derived.read(spark, sf_dir, "customer")
    key = (F.col("c_custkey") % 500).cast("string").alias("account_key")
    arriving = c.select(key, F.col("c_mktsegment").alias("institution"), F.when(F.col("c_acctbal") < 0, "card").otherwise("deposit").alias("kind"))
    return identity.new_accounts(arriving, arriving.where("CAST(account_key AS INT) % 3 = 0").select("account_key").distinct())


@query("""SELECT user_id, k, value FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, event_type, row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n = 1 AND event_type <> 'error'""")
def wrt_04_latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of judgements: the last of each user and number counts, and an error takes it back."""
    e = derived.read(spark, sf_dir, "events")
    log = e.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "value", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("deleted"))
    return identity.latest(log, ["user_id", "k"]).drop("at")
