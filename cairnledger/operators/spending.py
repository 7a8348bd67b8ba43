"""What counts as spending, and the totals, trends and listings over it.

The predicate is one set of anti-joins by transaction id; those three sides and the fact table are joined on the
same key, so a table bucketed by it is not shuffled again. Paybacks are aggregated before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.driver_tables import Ledger

#: Days of a range up to which it is shown by day, and below which by week.
DAILY_UP_TO, WEEKLY_BELOW = 14, 365
#: Buckets that a trailing average spans.
ROLLING = {"day": 7, "week": 4, "month": 3}
#: A search without a bound in days looks as far as two to this power.
MOST_DOUBLINGS = 18


def link_legs(ledger: Ledger) -> DataFrame:
    """The transactions on either side of a transfer; a one-sided link has one."""
    legs = ledger.transfer_link.select(F.explode(F.array("out_txn_id", "in_txn_id")).alias("txn_id"))
    return legs.where("txn_id IS NOT NULL").distinct()


def paid_back(ledger: Ledger) -> DataFrame:
    """What has been paid back on each charge."""
    income = ledger.txn.select(F.col("txn_id").alias("income_txn_id"), F.col("amount_minor").alias("income"))
    sums = ledger.payback.join(income, "income_txn_id").groupBy("expense_txn_id").agg(F.sum("income").alias("paid"))
    return sums.withColumnRenamed("expense_txn_id", "txn_id")


def in_direction(direction: str) -> Column:
    """out, in or net. Money in on a card is never income; a zero row counts only in net, and there not on a card."""
    on_card = F.col("kind") == "card"
    return {
        "out": F.col("amount_minor") < 0,
        "in": (F.col("amount_minor") > 0) & ~on_card,
        "net": (F.col("amount_minor") < 0) | ~on_card,
    }[direction]


def spending_base(ledger: Ledger, direction: str | None = None, exclude: list[int] | None = None) -> DataFrame:
    """Transactions that are no transfer leg, not hidden and no payback, with kind, paid and effective amounts."""
    rows = (
        ledger.txn.join(link_legs(ledger), "txn_id", "left_anti")
        .join(ledger.hidden, "txn_id", "left_anti")
        .join(ledger.payback.select(F.col("income_txn_id").alias("txn_id")), "txn_id", "left_anti")
        .join(ledger.account.select("account_id", "kind"), "account_id")
    )
    if exclude:
        rows = rows.where(~F.col("txn_id").isin(exclude))
    if direction:
        rows = rows.where(in_direction(direction))
    paid = F.coalesce("paid", F.lit(0).cast("long"))
    return rows.join(paid_back(ledger), "txn_id", "left").withColumns({"paid": paid, "effective": F.col("amount_minor") + paid})


def with_category(rows: DataFrame, ledger: Ledger) -> DataFrame:
    return rows.join(ledger.enrichment.select("txn_id", "category"), "txn_id", "left")


def filtered(
    rows: DataFrame, since=None, until=None, accounts: list[int] | None = None, categories: list[str] | None = None, text: str | None = None
) -> DataFrame:
    """Request filters; an empty list is no bound, a search drops the date range, and a blank is no search."""
    text = (text or "").strip()
    if text:
        low = F.lit(text.upper())
        rows = rows.where(F.contains(F.upper("counterparty_norm"), low) | F.contains(F.upper("description_raw"), low))
    else:
        if since is not None:
            rows = rows.where(F.col("posted_date") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("posted_date") <= F.lit(until))
    if accounts:
        rows = rows.where(F.col("account_id").isin(accounts))
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    return rows


def spending_summary(ledger: Ledger, direction: str = "out", **filters) -> DataFrame:
    """Rows and effective total of each category; no category is a group of its own. Largest spend first."""
    rows = filtered(with_category(spending_base(ledger, direction), ledger), **filters)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("effective").alias("total_minor")).orderBy("total_minor")


def averages(ledger: Ledger, since, until, direction: str = "out") -> DataFrame:
    """Total and half-even averages a day, week and 30-day month over an inclusive range; null averages if it is open."""
    days = (until - since).days + 1 if since and until else None
    total = filtered(spending_base(ledger, direction), since, until).agg(F.coalesce(F.sum("effective"), F.lit(0)).alias("total_minor"))
    per = lambda n, c: (F.bround(F.col("total_minor") * n / days).cast("long") if days else F.lit(None).cast("long")).alias(c)
    return total.select("total_minor", per(1, "per_day"), per(7, "per_week"), per(30, "per_month"))


def bucket_width(since, until) -> str:
    if since is None or until is None:
        return "month"
    days = (until - since).days + 1
    return "day" if days <= DAILY_UP_TO else "week" if days < WEEKLY_BELOW else "month"


def trend(ledger: Ledger, width: str, direction: str = "net", **filters) -> DataFrame:
    """Out, in, net and rows of each bucket, by the sign of the effective amount; a charge repaid in full is in."""
    rows = filtered(with_category(spending_base(ledger, direction), ledger), **filters)
    e = F.col("effective")
    zero = F.lit(0).cast("long")
    return rows.groupBy(F.to_date(F.date_trunc(width, "posted_date")).alias("bucket")).agg(
        F.sum(F.when(e < 0, e).otherwise(zero)).alias("out_minor"),
        F.sum(F.when(e >= 0, e).otherwise(zero)).alias("in_minor"),
        F.sum(e).alias("net_minor"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def rolling(buckets: DataFrame, width: str) -> DataFrame:
    """Trailing average of out over the present buckets, and how many it spans. Buckets number one a day at most."""
    near = Window.orderBy("bucket").rowsBetween(1 - ROLLING[width], 0)
    return buckets.select(
        "*",
        F.bround(F.sum("out_minor").over(near) / F.count(F.lit(1)).over(near)).cast("long").alias("rolling_minor"),
        F.count(F.lit(1)).over(near).alias("rolling_of"),
    )


def trend_centre(buckets: DataFrame) -> DataFrame:
    spent = buckets.where("out_minor < 0")
    return spent.agg(F.bround(F.avg("out_minor")).cast("long").alias("mean_minor"), F.bround(F.median("out_minor")).cast("long").alias("median_minor"))


def listing(ledger: Ledger, direction: str = "out", limit: int = 1000, offset: int = 0, **filters) -> DataFrame:
    """A page of the spending, newest first."""
    rows = filtered(with_category(spending_base(ledger, direction), ledger), **filters)
    page = rows.orderBy(F.col("posted_date").desc(), F.col("txn_id").desc()).offset(offset).limit(min(limit, 1000))
    return page.select("txn_id", "account_id", "posted_date", "amount_minor", "effective", "category", "counterparty_norm")


def targets(ledger: Ledger) -> DataFrame:
    """Outflows that are no transfer leg: what is categorised and searched for recurrence. Hidden rows are among them."""
    return ledger.txn.where("amount_minor < 0").join(link_legs(ledger), "txn_id", "left_anti")


def category_totals(ledger: Ledger) -> DataFrame:
    rows = ledger.enrichment.join(ledger.txn.select("txn_id", "amount_minor"), "txn_id")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount_minor").alias("total_minor"))


def counterparty_counts(ledger: Ledger, names: DataFrame) -> DataFrame:
    """Rows of each counterparty that `names` (counterparty_norm) lists."""
    rows = ledger.txn.join(names.distinct(), "counterparty_norm", "left_semi")
    return rows.groupBy("counterparty_norm").agg(F.count(F.lit(1)).alias("n_rows"))


def daily_movement(ledger: Ledger) -> DataFrame:
    """Movement of each account and day; a row after the end of the statement it was printed on counts on the last day."""
    rows = ledger.txn.join(ledger.balance.select("document_id", "account_id", "period_end"), ["document_id", "account_id"])
    day = F.least("posted_date", "period_end")
    return rows.groupBy("account_id", day.alias("day")).agg(F.sum("amount_minor").alias("moved_minor"))


def currencies(ledger: Ledger) -> DataFrame:
    return ledger.txn.agg(F.count_distinct("currency").alias("n_currencies"), F.min("currency").alias("currency"))


def single_currency(ledger: Ledger) -> str | None:
    """The ledger's currency; mixed currencies are refused."""
    r = currencies(ledger).first()
    if r["n_currencies"] > 1:
        raise ValueError("amounts of more than one currency do not add up")
    return r["currency"]


def hidden_total(ledger: Ledger) -> DataFrame:
    rows = ledger.txn.join(ledger.hidden, "txn_id", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("total_minor"))


def marked_total(ledger: Ledger) -> DataFrame:
    """Rows and total of the outflows that a person marked as transfers."""
    marked = ledger.transfer_link.where("origin = 'manual'").select(F.col("out_txn_id").alias("txn_id")).distinct()
    rows = ledger.txn.join(marked, "txn_id", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("total_minor"))


def payback_total(ledger: Ledger) -> DataFrame:
    return paid_back(ledger).agg(F.count(F.lit(1)).alias("n_charges"), F.sum("paid").alias("total_minor"))


def counts(ledger: Ledger) -> DataFrame:
    """Accounts, cards, transactions and statements of each institution."""
    per_account = ledger.txn.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    statements = ledger.balance.groupBy("account_id").agg(F.count(F.lit(1)).alias("s"))
    rows = ledger.account.join(per_account, "account_id", "left").join(statements, "account_id", "left")
    return rows.groupBy("institution").agg(
        F.count(F.lit(1)).alias("n_accounts"), F.count_if(F.col("kind") == "card").alias("n_cards"), F.sum("n").alias("n_txns"), F.sum("s").alias("n_statements")
    )


def category_usage(ledger: Ledger, rules: DataFrame) -> DataFrame:
    """How many rules and transactions use each category."""
    by_rule = rules.groupBy("category").agg(F.count(F.lit(1)).alias("n_rules"), F.lit(0).cast("long").alias("n_txns"))
    by_txn = ledger.enrichment.groupBy("category").agg(F.lit(0).cast("long").alias("n_rules"), F.count(F.lit(1)).alias("n_txns"))
    return by_rule.unionByName(by_txn).groupBy("category").agg(F.sum("n_rules").alias("n_rules"), F.sum("n_txns").alias("n_txns"))


def decisions(ledger: Ledger) -> DataFrame:
    """Transfer links with both legs' amounts; a one-sided link keeps a null."""
    leg = lambda p: ledger.txn.select(F.col("txn_id").alias(f"{p}_txn_id"), F.col("amount_minor").alias(f"{p}_minor"))
    return ledger.transfer_link.join(leg("out"), "out_txn_id").join(leg("in"), "in_txn_id", "left").select("out_txn_id", "out_minor", "in_txn_id", "in_minor", "origin")


def payback_pairs(ledger: Ledger) -> DataFrame:
    leg = lambda p: ledger.txn.select(F.col("txn_id").alias(f"{p}_txn_id"), F.col("amount_minor").alias(f"{p}_minor"))
    return ledger.payback.join(leg("expense"), "expense_txn_id").join(leg("income"), "income_txn_id").select("expense_txn_id", "expense_minor", "income_txn_id", "income_minor")


def distinct_counts(ledger: Ledger) -> DataFrame:
    """How many merchants and accounts the spending has."""
    rows = spending_base(ledger, "out")
    return rows.agg(F.count_distinct("counterparty_norm").alias("n_merchants"), F.count_distinct("account_id").alias("n_accounts"))


def payback_candidates(ledger: Ledger, charges: DataFrame, days: int | None = None, text: str | None = None, limit: int | None = 100) -> DataFrame:
    """For each charge (charges: txn_id): the inflows of any account that could settle it, nearest first by days, of as near ones the
    latest id; within so many days, and so many for each charge, if given. A search narrows the inflows by name or line. What settles
    a charge already, is a leg of a transfer or hidden is not offered; charges that are not in the ledger give none.

    Both sides meet by an equality of slots of days. Without a bound in days, each charge gets one: the least power of two of days
    within which the limit is reached, read from the running number of inflows by day.
    """
    if days is None and limit is None:
        raise ValueError("every inflow for every charge: give days or a limit")
    dated = ledger.txn.join(charges.select("txn_id").distinct(), "txn_id", "left_semi").select(F.col("txn_id").alias("charge_id"), F.col("posted_date").alias("charged"))
    income = filtered(spending_base(ledger, "in"), text=text).select("txn_id", "account_id", "posted_date", "amount_minor")
    # What can settle a charge depends on its day alone, so days meet inflows, and charges of a day share what was found for it.
    near = dated.select("charged").distinct()
    near = near.withColumn("reach", F.lit(days)) if days is not None else near.join(reaches(near, income, limit), "charged")
    if limit is not None:
        # Of the inflows of one day, which are equally near to any charge, none but the latest so many can be among those returned.
        latest = Window.partitionBy("posted_date").orderBy(F.col("txn_id").desc())
        income = income.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= limit).drop("n")
    slot = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / (F.col("reach") + 1))
    near = near.withColumn("slot", F.explode(F.array(slot("charged") - 1, slot("charged"), slot("charged") + 1)))
    # The reaches in use are one, or at most the powers of two that are tried.
    used = [days] if days is not None else [r["reach"] for r in near.select("reach").distinct().collect()]
    dealt = income.withColumn("reach", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    apart = F.abs(F.datediff("posted_date", "charged"))
    found = near.join(dealt.withColumn("slot", slot("posted_date")), ["reach", "slot"]).withColumn("days_apart", apart).where("days_apart <= reach")
    if limit is not None:
        order = Window.partitionBy("charged").orderBy("days_apart", F.col("txn_id").desc())
        found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    found = dated.select("charge_id", "charged").join(found.select("charged", "txn_id", "account_id", "amount_minor", "days_apart"), "charged")
    return found.select("charge_id", "txn_id", "account_id", "amount_minor", "days_apart").orderBy("charge_id", "days_apart", F.col("txn_id").desc())


def reaches(charges: DataFrame, income: DataFrame, limit: int) -> DataFrame:
    """(charged, reach) of each day of a charge: the least power of two of days that has `limit` inflows on either side, or that has all."""
    daily = income.groupBy("posted_date").agg(F.count(F.lit(1)).alias("n"))
    all_ = daily.agg(F.min("posted_date").alias("a"), F.max("posted_date").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    first, last, total = F.lit(all_["a"]).cast("date"), F.lit(all_["b"]).cast("date"), all_["total"]
    # Only days are put in order; those without inflows have the number of the last that has some.
    calendar = charges.sparkSession.range(1 if total else 0).select(F.explode(F.sequence(first, last)).alias("day"))
    counted = calendar.join(daily.withColumnRenamed("posted_date", "day"), "day", "left").select("day", F.coalesce(F.sum("n").over(Window.orderBy("day")), F.lit(0)).alias("so_far"))
    tried = charges.select("charged").distinct().withColumn("reach", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST_DOUBLINGS)), lambda i: F.call_function("shiftleft", F.lit(1), i))))
    within = lambda day, name: counted.select(F.col("day").alias(day), F.col("so_far").alias(name))
    ends = tried.withColumns({"until": F.least(F.date_add("charged", F.col("reach")), last), "before": F.date_sub("charged", F.col("reach") + 1)})
    met = ends.join(within("until", "upper"), "until", "left").join(within("before", "lower"), "before", "left")
    n = F.coalesce("upper", F.lit(0)) - F.when(F.col("before") >= last, total).otherwise(F.coalesce("lower", F.lit(0)))
    return met.where((n >= limit) | (n >= total)).groupBy("charged").agg(F.min("reach").cast("int").alias("reach"))
