"""Inputs that operators need and the given tables don't have as such, derived from them by Spark: printed amounts and dates,
statements and their rows, occurrences, placed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, ingest, transfers
from ..operators.categories import literal_of
from ..operators.grouped import stored
from ..sources import statement_forms
from ..sources.driver_tables import Ledger, events

#: Rules over part names (pattern, category, weight); one is a literal, two tie.
PART_RULES = (
    (r"\bWIDGET\b", "Electronics", 0),
    (r"\bBOLT\b", "Furnishing", 0),
    (r"^RED\ BOLT$", "Fashion", 0),
    (r"\bSMALL\b", "Fashion", 1),
    (r"\bBLUE\b", "Travel", 0),
    (r"\bRING\b", "Dining", 0),
)
#: Rules over shops: two tie on some, one is a literal, one weighs more.
SHOP_RULES = (
    (r"\bSHOP [0-9]\b", "Grocery", 0),
    (r"\bSHOP 1[0-9]\b", "Dining", 0),
    (r"\bSHOP 1[5-9]\b", "Travel", 0),
    (r"^ERROR\ SHOP\ 30$", "Fashion", 0),
    (r"\bPURCHASE\b", "Business services", -1),
    (r"\bSHOP 2[0-9]\b", "Transport", 2),
    (r"\bSHOP 2", "Healthcare", 0),
)
#: Columns of the placed words, half-open.
BANDS = [("date", 50.0, 140.0), ("text", 140.0, 360.0), ("amount", 360.0, 600.0)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part_rules(spark: SparkSession) -> DataFrame:
    return rules_of(spark, PART_RULES)


def rules_of(spark: SparkSession, rules: tuple[tuple[str, str, int], ...]) -> DataFrame:
    rows = [(p, c, w, literal_of(p)) for p, c, w in rules]
    return spark.createDataFrame(rows, "pattern string, category string, weight int, literal string")


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as outflows to the names of their parts."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("name"))
    items = read(spark, sf_dir, "lineitem").select("l_partkey", (-F.round(F.col("l_extendedprice") * 100).cast("long")).alias("amount_minor"))
    return items.join(part, "l_partkey").select("name", "amount_minor")


def counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with what else is found among counterparties: persons, accounts, conduits, names with white space around them, and none."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("part"))
    items = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    kind, own = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(11)), F.col("part")
    name = (
        F.when(kind == 0, F.concat(F.lit("PayNow to "), own)).when(kind == 1, F.concat(F.lit("atm "), own)).when(kind == 2, F.concat(F.lit(" \t"), own, F.lit("  ")))
        .when(kind == 3, F.concat(own, F.lit(" 123-4567890"))).when(kind == 4, F.when(F.col("l_linenumber") % 2 == 0, F.lit("  "))).when(kind == 5, F.lit("Cash Withdrawal"))
    )
    return items.select(F.when(kind < 6, name).otherwise(own).alias("name"), (-F.round(F.col("l_extendedprice") * 100).cast("long")).alias("amount_minor"))


def statement_tables(l: Ledger) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """Weekly statements and their rows in order of time; a row falls on its statement by account and week."""
    null = lambda t: F.lit(None).cast(t)
    declared = l.balance.select(
        F.col("document_id").alias("doc"), "account_id", "opening_minor", "closing_minor", null("long").alias("declared_out"), null("long").alias("declared_in"),
        null("long").alias("declared_count"), "period_start", "period_end", F.lit(0).alias("grace_days"),
    )
    return declared, l.txn.select(
        F.col("document_id").alias("doc"), "account_id", F.col("txn_id").alias("pos"), "posted_date", null("date").alias("value_date"), "amount_minor", null("int").alias("column_sign"), F.lit("").alias("section")
    )


def account_statements(l: Ledger) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """A document for each account with rows in two sections: every third has no balances, every eleventh is one unit off, odd ones have their
    rows in a scattered order; the period ends on the 25th of January, with three days of grace."""
    null = lambda t: F.lit(None).cast(t)
    pos = F.when(F.col("account_id") % 2 == 0, F.col("txn_id")).otherwise((F.col("txn_id") * 7919) % 10007 * 100_000_000 + F.col("txn_id"))
    rows = l.txn.select(
        F.col("account_id").alias("doc"), "account_id", pos.alias("pos"), "posted_date", null("date").alias("value_date"), "amount_minor", null("int").alias("column_sign"), (F.col("txn_id") % 2).cast("string").alias("section")
    )
    stated, off = F.col("account_id") % 3 != 0, F.when(F.col("account_id") % 11 == 0, 1).otherwise(0)
    declared = rows.groupBy("doc", "account_id").agg(F.sum("amount_minor").alias("total")).select(
        "doc", "account_id", F.when(stated, F.lit(0).cast("long")).alias("opening_minor"), F.when(stated, F.col("total") + off).alias("closing_minor"), null("long").alias("declared_out"), null("long").alias("declared_in"),
        null("long").alias("declared_count"), F.lit("2024-01-01").cast("date").alias("period_start"), F.lit("2024-01-25").cast("date").alias("period_end"), F.lit(3).alias("grace_days"),
    )
    return declared, rows


def combined_statements(l: Ledger) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """Documents of four accounts over all of the ledger's time, without balances. Every ninth account's declared total is one unit off, and
    the declared count is even."""
    null = lambda t: F.lit(None).cast(t)
    doc = F.floor(F.col("account_id") / 4).cast("long")
    rows = l.txn.select(
        doc.alias("doc"), "account_id", F.col("txn_id").alias("pos"), F.lit("2024-01-01").cast("date").alias("posted_date"), null("date").alias("value_date"), "amount_minor", null("int").alias("column_sign"), F.lit("").alias("section")
    )
    sums = rows.groupBy("doc", "account_id").agg(
        (-F.sum(F.least("amount_minor", F.lit(0))) + F.when(F.col("account_id") % 9 == 0, 1).otherwise(0)).alias("declared_out"), F.sum(F.greatest("amount_minor", F.lit(0))).alias("declared_in"), F.count(F.lit(1)).alias("n")
    )
    count = rows.groupBy("doc").agg((F.floor((F.count(F.lit(1)) + 1) / 2) * 2).cast("long").alias("declared_count"))
    day = lambda c: F.lit("2024-01-01").cast("date").alias(c)
    return sums.join(count, "doc").select("doc", "account_id", null("long").alias("opening_minor"), null("long").alias("closing_minor"), "declared_out", "declared_in", "declared_count", day("period_start"), day("period_end"), F.lit(0).alias("grace_days")), rows


def sure_links(l: Ledger) -> DataFrame:  # noqa: E741
    """Links of legs that have one candidate each: whatever the order, these are settled."""
    sure = transfers.lone_pairs(transfers.legs_of(l))
    return sure.select("out_txn_id", "in_txn_id", F.element_at(F.array(*map(F.lit, transfers.EVIDENCE)), F.array_position("passes", True).cast("int")).alias("evidence"), F.col("amount").alias("amount_minor"))


def closing_early(balance: DataFrame) -> DataFrame:
    """Balances of which every third account has none after the second week."""
    return balance.where("NOT (account_id % 3 = 0 AND period_end > DATE '2024-01-14')")


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as printed lines: each third row has a line above it, each second one below, and all have stray ones further off."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    line = lambda n, when, off, words: F.when(when, F.struct(F.lit(n).alias("n"), (F.col("l_linenumber") * 100.0 + off).alias("top"), F.concat(F.lit(words), F.col("l_linenumber").cast("string")).alias("text"), F.lit(n == 2).alias("value")))
    always, number = F.lit(True), F.col("l_linenumber")
    printed = F.array_compact(F.array(line(0, always, -30, "far above "), line(1, number % 3 == 0, -8, "lead "), line(2, always, 0, "row "), line(3, number % 2 == 0, 9, "more "), line(4, always, 19, "far below ")))
    each = items.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), "l_linenumber", F.explode(printed).alias("x"))
    return each.select("doc", "page", (F.col("l_linenumber") * 5 + F.col("x.n")).cast("int").alias("line"), "x.top", "x.text", "x.value")


def printed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages with a title, a header and a row whose amount is right-aligned under one of two headings; all is shifted by order."""
    o = read(spark, sf_dir, "orders")
    shift = F.pmod("o_orderkey", F.lit(40)).cast("double")
    word = lambda x0, x1, t: F.struct((F.lit(float(x0)) + shift).alias("x0"), (F.lit(float(x1)) + shift).alias("x1"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    amount = F.format_number("o_totalprice", 2)
    under = F.when(F.col("o_orderstatus") == "O", word(310, 352, amount)).otherwise(word(385, 427, amount))
    lines = F.array(
        F.struct(F.lit(0).alias("line"), F.lit(10.0).alias("top"), F.array(word(50, 80, "ACME"), word(90, 120, "Bank")).alias("words")),
        F.struct(F.lit(1).alias("line"), F.lit(30.0).alias("top"), F.array(word(50, 75, "Date"), word(120, 180, "Details"), word(300, 350, "Withdrawal"), word(380, 425, "Deposit"), word(460, 510, "Balance")).alias("words")),
        F.struct(F.lit(2).alias("line"), F.lit(50.0).alias("top"), F.array(word(50, 75, "01/06"), word(120, 150, "ORDER"), word(155, 290, F.col("o_orderkey").cast("string")), under).alias("words")),
        F.struct(F.lit(3).alias("line"), F.lit(90.0).alias("top"), F.array(word(50, 75, "Page"), word(80, 90, "1")).alias("words")),
    )
    return o.select(F.col("o_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(lines).alias("l")).select("doc", "page", "l.*")


def keyed_rows(l: Ledger) -> DataFrame:  # noqa: E741
    """Transactions with their dedupe keys; descriptions leave out the shop, so identical rows occur."""
    account = l.account.select("account_id", identity.natural_key(F.col("account_ref"), F.lit(""), F.col("currency")).alias("account_key"))
    rows = l.txn.join(account, "account_id").select(
        "txn_id", F.col("account_id").cast("string").alias("doc"), "account_key", "posted_date", "amount_minor",
        F.substring_index("counterparty_norm", " SHOP", 1).alias("description_norm"),
    )
    return identity.with_seq(rows, pos="txn_id").withColumn("dedupe_key", identity.dedupe_key()).select("txn_id", "doc", "seq", "dedupe_key")


def statement_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements, their suppliers as accounts."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("string").alias("ref"))
    day = F.to_date("o_orderdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("doc_type"), day.alias("period_start"), F.date_add(day, 30).alias("period_end"))
    return orders.join(items, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("doc"), "doc_type", "period_start", "period_end", "ref")


def printed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as statements print them: with a symbol, with a code, and in brackets for negatives."""
    plain = F.format_number(F.round("o_totalprice", 2), 2)
    shape = F.when(F.col("o_orderstatus") == "F", F.concat(plain, F.lit(" USD"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("("), plain, F.lit(")")))
    return read(spark, sf_dir, "orders").select("o_orderkey", shape.otherwise(F.concat(F.lit("S$"), plain)).alias("printed"))


def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("day"), F.date_format(day, "d MMMM yyyy").alias("named"), F.date_format(day, "dd/MM/yy").alias("two"),
        F.date_format(day, "dd/MM/yyyy").alias("numeric"), F.date_format(day, "dd/MM").alias("yearless"), F.date_sub(day, 10).alias("start"), F.date_add(day, 20).alias("end"),
    )


def printed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat("p_name", F.lit("  "), F.regexp_replace("p_brand", "#", " "))
    reference = F.lpad(F.col("p_partkey").cast("string"), 7, "7")
    return read(spark, sf_dir, "part").select("p_partkey", plain.alias("plain"), F.concat(F.lit("giro  "), plain, F.lit(" AVI"), reference, F.lit(" SG")).alias("decorated"))


def printed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("o_orderkey").cast("string"), 16, "4")
    grouped = F.regexp_replace(number, r"(\d{4})(?=\d)", "$1-")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Bill Payment "), F.when(F.col("o_orderstatus") == "P", grouped).otherwise(number), F.lit(" thanks")).alias("line"))


def model_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of event, as models, make of each shop, from their least amounts."""
    least = events(spark, sf_dir).groupBy(F.col("event_type").alias("model"), "k").agg(F.min("amount_minor").alias("a"))
    rest = F.pmod("a", F.lit(3))
    category = F.when(rest == 0, "Dining").when(rest == 1, "Grocery").otherwise("Nonsense")
    return least.select("model", F.concat(F.lit("SHOP "), F.col("k").cast("string")).alias("name"), category.alias("category"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten payments to each customer as a payee: five cadences, a jitter of a day, and for some a new price."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    key, i = F.col("c_custkey"), F.col("i")
    cadence = F.element_at(F.array(*map(F.lit, (7, 14, 30, 91, 47))), (key % 5 + 1).cast("int"))
    day = (key % 28 + i * cadence + ((key * (i + 1)) % 3 - 1)).cast("int")
    price = 1000 + key % 500 + F.when((i >= 6) & (key % 4 == 0), 900).otherwise(0)
    return c.select(
        (key * 100 + i).alias("txn_id"), F.concat(F.lit("PAYEE "), key.cast("string")).alias("merchant"), F.date_add(F.lit("2020-01-01").cast("date"), day).alias("posted_date"),
        (-price).cast("long").alias("amount_minor"), F.lit("card payment").alias("description"),
    )


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words on pages: a date, a text and an amount at each height, with a jitter of two points."""
    items = read(spark, sf_dir, "lineitem")
    top = 100.0 + F.col("l_linenumber") * 28 + F.pmod("l_partkey", F.lit(3))
    word = lambda x, t: F.struct(F.lit(x).alias("x0"), t.alias("text"))
    words = F.array(
        word(53.0, F.date_format("l_shipdate", "dd/MM/yyyy")), word(146.0, F.col("l_returnflag")), word(170.0, F.col("l_linestatus")), word(475.0, F.format_number("l_extendedprice", 2))
    )
    return items.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), top.alias("top"), F.explode(words).alias("w")).select("doc", "page", "top", "w.x0", (F.col("w.x0") + 40).alias("x1"), "w.text")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "/")).alias("label"))


def printed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as statements of two forms: (lines, documents). Every seventh does not add up, every eleventh has labels that no form has,
    and every thirteenth has a row whose day is none."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.trunc(F.to_date("o_orderdate"), "month").alias("start"))
    item = F.struct("l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("minor"), (F.col("l_returnflag") == "R").alias("is_out"))
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(item)).alias("items"))
    key = F.col("o_orderkey")
    signed = F.transform("items", lambda i: F.when(i["is_out"], -i["minor"]).otherwise(i["minor"]))
    total = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    d = o.join(items, "o_orderkey").withColumns({"total": total, "end": F.last_day("start"), "sectioned": key % 2 == 0, "no_day": key % 13 == 0})
    amount = lambda minor: F.concat(F.when(minor < 0, "-").otherwise(""), F.format_number((F.abs(minor) / 100).cast("decimal(18,2)"), 2))
    word = lambda x, t: F.struct(F.lit(float(x)).alias("x0"), (F.lit(float(x)) + 5.0 * F.length(t)).alias("x1"), t.alias("text"))
    right = lambda x, t: F.struct((F.lit(float(x)) - 5.0 * F.length(t)).alias("x0"), F.lit(float(x)).alias("x1"), t.alias("text"))
    # Words that stand side by side are one here, with spaces in it, where their places don't matter.
    line = lambda top, *words: F.struct(F.lit(float(top)).alias("top"), F.array(*words).alias("words"))
    said = lambda top, t: line(top, word(40, t))
    closing = 100_000_000 + F.col("total") + F.when(key % 7 == 0, 100).otherwise(0)
    number = F.concat(F.lit("500-"), F.lpad(key.cast("string"), 8, "0"))
    heads = [(130, "Description"), (300, "Withdrawal"), (380, "Deposit"), (460, "Balance")]

    def row(i: Column, k: Column) -> Column:
        top = 100.0 + 30.0 * k
        day = F.date_add("start", i["l_linenumber"])
        shown = F.when(F.col("no_day") & (k == 0), F.lit("99")).otherwise(F.date_format(day, "dd"))
        date = F.when(F.col("sectioned"), F.concat(shown, F.date_format(day, "/MM/yyyy"))).otherwise(F.concat(shown, F.date_format(day, " MMM")))
        money = F.when(i["is_out"], right(350, amount(i["minor"]))).otherwise(right(415, amount(i["minor"])))
        return F.array(
            F.struct(top.alias("top"), F.array(word(40, date), word(130, F.concat(F.lit("PART "), i["l_partkey"].cast("string"))), money).alias("words")),
            F.struct((top + 9).alias("top"), F.array(word(130, F.concat(F.lit("line "), i["l_linenumber"].cast("string")))).alias("words")),
        )

    rows = F.flatten(F.transform("items", row))
    end = F.date_format("end", "d MMM yyyy")
    first = F.array(
        said(10, F.concat(F.lit("Account Summary as at "), end)), said(20, F.concat(F.lit("Account No. "), number)), line(60, word(40, F.lit("Date")), *(word(x, F.lit(t)) for x, t in heads)),
        line(70, word(130, F.lit("Balance Brought Forward")), right(495, F.lit("1,000,000.00"))),
    )
    second = F.array(
        said(10, F.concat(F.date_format("start", "d MMM yyyy"), F.lit(" TO "), end)), said(20, F.concat(F.lit("Account No. "), number)),
        line(60, word(40, F.lit("Date")), word(90, F.lit("Date")), word(130, F.lit("Description")), word(250, F.lit("Cheque")), *(word(x, F.lit(t)) for x, t in heads[1:])), line(70, word(130, F.lit("BALANCE B/F")), right(495, F.lit("1,000,000.00"))),
    )
    last = line(900, word(130, F.when(F.col("sectioned"), "Balance Carried Forward").otherwise("BALANCE C/F")), right(495, amount(closing)))
    pages = d.select(key.cast("string").alias("doc"), F.posexplode(F.concat(F.when(F.col("sectioned"), first).otherwise(second), rows, F.array(last))).alias("line", "l"))
    lines = pages.select("doc", F.lit(1).alias("page"), "line", "l.top", "l.words")
    label = F.when(key % 11 == 0, "a letter").when(F.col("sectioned"), "account summary").otherwise("statement of account")
    made = F.when(F.col("sectioned"), F.array(F.lit("quadient"), F.lit("inspire"))).otherwise(F.array(F.lit("streamline"), F.lit("pdfgen")))
    return lines, d.select(key.cast("string").alias("doc"), F.array(label).alias("labels"), made.alias("tokens"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))


def assessed(spark: SparkSession, sf_dir: str) -> ingest.Assessed:
    """What those documents come to, beside a ledger without any."""
    lines, documents = printed_documents(spark, sf_dir)
    none = {n: spark.createDataFrame([], k.schema) for n, k in ingest.KINDS.items()}
    return ingest.assess(stored(lines), documents, statement_forms.signatures(spark), statement_forms.FORMS, none, fold=False)
