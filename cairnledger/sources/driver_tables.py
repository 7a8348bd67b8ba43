"""A ledger projected from event tables, so that every operator runs on whole tables of any size.

Events become transactions, users accounts; the number in an event's properties plays the judgement tables. The SQL in
`CTES` states the same projection for the checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Day that week-long statements are counted from.
EPOCH = "2024-01-01"


@dataclass(frozen=True)
class Ledger:
    account: DataFrame  # account_id, institution, account_ref, currency, kind
    txn: DataFrame  # txn_id, document_id, account_id, posted_date, amount_minor, currency, description_raw, counterparty_norm
    enrichment: DataFrame  # txn_id, category, source
    hidden: DataFrame  # txn_id
    transfer_link: DataFrame  # out_txn_id, in_txn_id (null: one-sided), origin
    payback: DataFrame  # expense_txn_id, income_txn_id
    balance: DataFrame  # document_id, account_id, period_start, period_end, opening_minor, closing_minor


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sign = F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1)
    return e.select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("account_id"),
        F.to_date("ts").alias("posted_date"),
        (F.round(F.col("value") * 100).cast("long") * sign).alias("amount_minor"),
        F.lit("SGD").alias("currency"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).where("amount_minor <> 0")


def week_of(day: str) -> Column:
    return F.floor(F.datediff(day, F.lit(EPOCH)) / 7).cast("int")


def document() -> Column:
    """The statement that a row was printed on: that of its account and week."""
    return (F.col("account_id") * 1000 + week_of("posted_date")).alias("document_id")


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    e = events(spark, sf_dir)
    card = F.col("account_id") % 3 == 0
    account = e.select("account_id").distinct().select(
        "account_id",
        F.concat(F.lit("BANK"), (F.col("account_id") % 5).cast("string")).alias("institution"),
        F.lpad(F.col("account_id").cast("string"), 10, "0").alias("account_ref"),
        F.lit("SGD").alias("currency"),
        F.when(card, "card").otherwise("deposit").alias("kind"),
    )
    name = F.concat(F.upper("event_type"), F.lit(" SHOP "), F.col("k").cast("string"))
    raw = F.concat(F.lit("Advice "), "event_type", F.lit(" shop "), F.col("k").cast("string"), F.lit(" ref "), (F.col("txn_id") + 100000).cast("string"))
    txn = e.select("txn_id", document(), "account_id", "posted_date", "amount_minor", "currency", raw.alias("description_raw"), name.alias("counterparty_norm"))
    category = F.when(F.col("k") < 20, "Grocery").when(F.col("k") < 40, "Dining").when(F.col("k") < 60, "Transport").otherwise("Travel")
    enrichment = e.where("k < 80").select("txn_id", category.alias("category"), F.when(F.col("k") % 2 == 0, "rule").otherwise("human").alias("source"))
    hidden = e.where("k = 13").select("txn_id")
    kind = lambda t, k, c: e.where((F.col("event_type") == t) & (F.col("k") == k)).groupBy("account_id").agg(F.min("txn_id").alias(c))
    two_sided = kind("purchase", 19, "out_txn_id").join(kind("click", 19, "in_txn_id"), "account_id", "left").select("out_txn_id", "in_txn_id", F.lit("auto").alias("origin"))
    one_sided = e.where("event_type = 'error' and k = 17").select(F.col("txn_id").alias("out_txn_id"), F.lit(None).cast("long").alias("in_txn_id"), F.lit("manual").alias("origin"))
    charges = e.where("event_type = 'purchase' and k >= 80").groupBy("account_id").agg(F.min("txn_id").alias("expense_txn_id"))
    payback = e.where("event_type = 'click' and k = 23").join(charges, "account_id").select("expense_txn_id", F.col("txn_id").alias("income_txn_id"))
    return Ledger(account, txn, enrichment, hidden, two_sided.unionByName(one_sided), payback, balances(txn))


def balances(txn: DataFrame) -> DataFrame:
    """Weekly statements of each account whose closings follow its movement, but for an error in some accounts."""
    moved = txn.groupBy("account_id", week_of("posted_date").alias("week")).agg(F.sum("amount_minor").alias("moved"))
    to_date = Window.partitionBy("account_id").orderBy("week")
    error = F.when((F.col("account_id") % 17 == 0) & (F.col("week") == 2), 100).otherwise(0)
    closing = F.sum("moved").over(to_date) + error
    start = F.date_add(F.lit(EPOCH).cast("date"), F.col("week") * 7)
    return moved.select(
        (F.col("account_id") * 1000 + F.col("week")).alias("document_id"),
        "account_id",
        start.alias("period_start"),
        F.date_add(start, 6).alias("period_end"),
        (F.sum("moved").over(to_date) - F.col("moved")).alias("opening_minor"),
        closing.alias("closing_minor"),
    )


CTES = f"""
ev AS (SELECT * FROM (SELECT event_id AS txn_id, user_id AS account_id, CAST(ts AS DATE) AS posted_date,
    CAST(ROUND(value * 100) AS BIGINT) * CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END AS amount_minor,
    'SGD' AS currency, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE amount_minor <> 0),
account AS (SELECT DISTINCT account_id, 'BANK' || CAST(account_id % 5 AS VARCHAR) AS institution, lpad(CAST(account_id AS VARCHAR), 10, '0') AS account_ref,
    'SGD' AS currency, CASE WHEN account_id % 3 = 0 THEN 'card' ELSE 'deposit' END AS kind FROM ev),
txn AS (SELECT txn_id, account_id * 1000 + CAST(floor(date_diff('day', DATE '{EPOCH}', posted_date) / 7.0) AS BIGINT) AS document_id, account_id, posted_date, amount_minor, currency,
    'Advice ' || event_type || ' shop ' || CAST(k AS VARCHAR) || ' ref ' || CAST(txn_id + 100000 AS VARCHAR) AS description_raw,
    upper(event_type) || ' SHOP ' || CAST(k AS VARCHAR) AS counterparty_norm FROM ev),
enrichment AS (SELECT txn_id, CASE WHEN k < 20 THEN 'Grocery' WHEN k < 40 THEN 'Dining' WHEN k < 60 THEN 'Transport' ELSE 'Travel' END AS category,
    CASE WHEN k % 2 = 0 THEN 'rule' ELSE 'human' END AS source FROM ev WHERE k < 80),
hidden AS (SELECT txn_id FROM ev WHERE k = 13),
transfer_link AS (SELECT o.out_txn_id, i.in_txn_id, 'auto' AS origin
    FROM (SELECT account_id, min(txn_id) AS out_txn_id FROM ev WHERE event_type = 'purchase' AND k = 19 GROUP BY 1) o
    LEFT JOIN (SELECT account_id, min(txn_id) AS in_txn_id FROM ev WHERE event_type = 'click' AND k = 19 GROUP BY 1) i USING (account_id)
    UNION ALL SELECT txn_id, NULL, 'manual' FROM ev WHERE event_type = 'error' AND k = 17),
payback AS (SELECT c.expense_txn_id, e.txn_id AS income_txn_id FROM ev e
    JOIN (SELECT account_id, min(txn_id) AS expense_txn_id FROM ev WHERE event_type = 'purchase' AND k >= 80 GROUP BY 1) c USING (account_id)
    WHERE e.event_type = 'click' AND e.k = 23),
weekly AS (SELECT account_id, CAST(date_diff('day', DATE '{EPOCH}', posted_date) // 7 AS INTEGER) AS week, CAST(sum(amount_minor) AS BIGINT) AS moved
    FROM txn GROUP BY 1, 2),
balance AS (SELECT account_id * 1000 + week AS document_id, account_id, DATE '{EPOCH}' + week * 7 AS period_start, DATE '{EPOCH}' + week * 7 + 6 AS period_end,
    CAST(sum(moved) OVER w AS BIGINT) - moved AS opening_minor,
    CAST(sum(moved) OVER w AS BIGINT) + CASE WHEN account_id % 17 = 0 AND week = 2 THEN 100 ELSE 0 END AS closing_minor
    FROM weekly WINDOW w AS (PARTITION BY account_id ORDER BY week)),
base AS (SELECT t.*, a.kind, coalesce(p.paid, 0) AS paid, t.amount_minor + coalesce(p.paid, 0) AS effective FROM txn t JOIN account a USING (account_id)
    LEFT JOIN (SELECT expense_txn_id, CAST(sum(i.amount_minor) AS BIGINT) AS paid FROM payback JOIN txn i ON i.txn_id = income_txn_id GROUP BY 1) p ON p.expense_txn_id = t.txn_id
    WHERE t.txn_id NOT IN (SELECT out_txn_id FROM transfer_link) AND t.txn_id NOT IN (SELECT in_txn_id FROM transfer_link WHERE in_txn_id IS NOT NULL)
    AND t.txn_id NOT IN (SELECT txn_id FROM hidden) AND t.txn_id NOT IN (SELECT income_txn_id FROM payback))
"""
