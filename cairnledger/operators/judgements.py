"""What people decide about rows: append-only logs whose current state is the last entry of each key.

Each log is a narrow table of entries with `at` and `deleted`; a change is an append of one batch, so it is atomic, and
undoing is another entry. Guards are joins that find the offending rows of a whole batch; any refusal refuses all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import carried_over, latest
from .spending import link_legs, paid_back
from ..sources.driver_tables import Ledger


class Refused(ValueError):
    """A batch that breaks a rule; nothing of it is applied."""


def current(log: DataFrame, keys: list[str]) -> DataFrame:
    return latest(log, keys).drop("at")


def hide(ids: DataFrame, at) -> DataFrame:
    return ids.select("txn_id", F.lit(at).cast("timestamp").alias("at"), F.lit(False).alias("deleted"))


def unhide(ids: DataFrame, at) -> DataFrame:
    return ids.select("txn_id", F.lit(at).cast("timestamp").alias("at"), F.lit(True).alias("deleted"))


def set_categories(decided: DataFrame, at) -> DataFrame:
    """Entries (txn_id, category) of a person; a null category takes the decision back."""
    return decided.select("txn_id", "category", F.lit("human").alias("source"), F.lit(at).cast("timestamp").alias("at"), F.col("category").isNull().alias("deleted"))


def save_settings(settings: DataFrame, defaults: DataFrame, at) -> DataFrame:
    """Entries (key, value) that differ from the defaults; a value at its default deletes the override."""
    both = settings.join(defaults.select("key", F.col("value").alias("usual")), "key", "left")
    return both.select("key", "value", F.lit(at).cast("timestamp").alias("at"), (F.col("value").isNull() | F.col("value").eqNullSafe(F.col("usual"))).alias("deleted"))


def payback_faults(ledger: Ledger, links: DataFrame) -> DataFrame:
    """(income_txn_id, fault) of links (expense_txn_id, income_txn_id) that can't be made: unknown rows, a charge that is no
    outflow, an income that is none, one already settling, transfer or hidden rows, and more than the charge."""
    leg = lambda p: ledger.txn.select(F.col("txn_id").alias(f"{p}_txn_id"), F.col("amount_minor").alias(f"{p}_minor"))
    flag = lambda ids, p, c: ids.select(F.col("txn_id").alias(f"{p}_txn_id"), F.lit(True).alias(c))
    tied = link_legs(ledger).unionByName(ledger.hidden.select("txn_id")).distinct()
    settling = ledger.payback.select(F.col("income_txn_id").alias("txn_id")).distinct()
    before = paid_back(ledger).select(F.col("txn_id").alias("expense_txn_id"), "paid")
    rows = links.distinct().join(leg("expense"), "expense_txn_id", "left").join(leg("income"), "income_txn_id", "left")
    rows = rows.join(flag(tied, "expense", "e_tied"), "expense_txn_id", "left").join(flag(tied, "income", "i_tied"), "income_txn_id", "left")
    rows = rows.join(flag(settling, "income", "settles"), "income_txn_id", "left").join(before, "expense_txn_id", "left")
    total = rows.groupBy("expense_txn_id").agg(F.sum("income_minor").alias("total"))
    twice = rows.groupBy("income_txn_id").agg((F.count(F.lit(1)) > 1).alias("twice"))
    rows = rows.join(total, "expense_txn_id").join(twice, "income_txn_id")
    fault = (
        F.when(F.col("expense_minor").isNull() | F.col("income_minor").isNull(), "unknown transaction")
        .when(F.col("expense_minor") >= 0, "the charge is no outflow")
        .when(F.col("income_minor") <= 0, "the payback is no inflow")
        .when(F.coalesce("settles", F.lit(False)) | F.col("twice"), "it settles a charge already")
        .when(F.coalesce("e_tied", "i_tied", F.lit(False)), "a transfer or hidden row")
        .when(F.col("expense_minor") + F.coalesce("paid", F.lit(0)) + F.col("total") > 0, "more than the charge")
    )
    return rows.select("income_txn_id", fault.alias("fault")).where("fault IS NOT NULL")


def link_paybacks(ledger: Ledger, links: DataFrame, at) -> DataFrame:
    """Log entries of the links, or Refused."""
    if links.isEmpty():
        raise Refused("no paybacks named")
    if first := payback_faults(ledger, links).orderBy("income_txn_id").first():
        raise Refused(f"{first['income_txn_id']}: {first['fault']}")
    return links.distinct().select("expense_txn_id", "income_txn_id", F.lit(at).cast("timestamp").alias("at"), F.lit(False).alias("deleted"))


def unlink_paybacks(ledger: Ledger, expense_txn_id: int, at, income_txn_id: int | None = None) -> DataFrame:
    """Entries that take back one link of a charge, or all."""
    rows = ledger.payback.where(F.col("expense_txn_id") == expense_txn_id)
    rows = rows if income_txn_id is None else rows.where(F.col("income_txn_id") == income_txn_id)
    return rows.select("expense_txn_id", "income_txn_id", F.lit(at).cast("timestamp").alias("at"), F.lit(True).alias("deleted"))


def mark_transfers(ledger: Ledger, marks: DataFrame, at) -> DataFrame:
    """Manual links (out_txn_id, in_txn_id or null) as log entries; a row that is a leg already, or twice here, is refused."""
    legs = marks.select(F.explode(F.array("out_txn_id", "in_txn_id")).alias("txn_id")).where("txn_id IS NOT NULL")
    taken = legs.join(link_legs(ledger), "txn_id", "left_semi").unionByName(legs.groupBy("txn_id").count().where("count > 1").select("txn_id"))
    unknown = legs.join(ledger.txn, "txn_id", "left_anti")
    if first := taken.unionByName(unknown).first():
        raise Refused(f"{first['txn_id']} is unknown or a transfer leg already")
    return marks.select("out_txn_id", "in_txn_id", F.lit("manual").alias("origin"), F.lit(at).cast("timestamp").alias("at"), F.lit(False).alias("deleted"))


def without_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without what stems from documents (document_id): rows by document, judgements by the rows' ids."""
    txn = tables["txn"]
    lost = txn.join(gone, "document_id", "left_semi").select("txn_id")
    out = {n: df.join(gone, "document_id", "left_anti") for n, df in tables.items() if "document_id" in df.columns}
    out |= {n: df.join(lost, "txn_id", "left_anti") for n, df in tables.items() if n not in out and "txn_id" in df.columns}
    if "transfer_link" in tables:
        links = tables["transfer_link"]
        for leg in ("out_txn_id", "in_txn_id"):
            links = links.join(lost.withColumnRenamed("txn_id", leg), leg, "left_anti")
        out["transfer_link"] = links.select(*tables["transfer_link"].columns)
    if "payback" in tables:
        pairs = tables["payback"]
        for leg in ("expense_txn_id", "income_txn_id"):
            pairs = pairs.join(lost.withColumnRenamed("txn_id", leg), leg, "left_anti")
        out["payback"] = pairs.select(*tables["payback"].columns)
    return tables | out


def reapplied(decisions: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restored, dropped) decisions after a document was read anew, by dedupe key."""
    moved = carried_over(decisions, old, new)
    return moved.where("txn_id IS NOT NULL"), moved.where("txn_id IS NULL")


def marked_series(marks: DataFrame, at) -> DataFrame:
    """Entries (merchant, centre_minor, period_label) of series that a person declares."""
    return marks.select("merchant", "centre_minor", "period_label", F.lit(at).cast("timestamp").alias("at"), F.lit(False).alias("deleted"))


def dismissed_series(series: DataFrame, at, restore: bool = False) -> DataFrame:
    """Entries (merchant, centre_minor) of series that a person dismisses, or takes back."""
    return series.select("merchant", "centre_minor", F.lit(at).cast("timestamp").alias("at"), F.lit(restore).alias("deleted"))
