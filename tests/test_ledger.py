"""Hand-computed cases of the ledger operators."""

import dataclasses
import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnledger.functions import dates, money, text
from cairnledger.operators import categories, forms, geometry, grouped, identity, judgements, layout, recurrence, spending, statements, transfers
from cairnledger.plans import derived, registry
from cairnledger.sources import archive, files, statement_forms
from cairnledger.sources.driver_tables import Ledger, ledger
from cairnledger.streaming import intake

SF = "/root/testdata/sf0.001"
DAY0 = dt.date(2026, 6, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "printed, minor, currency",
    [
        ("S$9,080.70", 908070, "SGD"), ("+64.02", 6402, None), ("81.19 USD", 8119, "USD"), ("(7.30)", -730, None), ("62.50-", -6250, None),
        ("-(8.10)", 810, None), ("¥940", 940, "JPY"), ("2.718 KWD", 2718, "KWD"), ("3.007", None, None), ("-$ 6", -600, None), ("54 321.00", 5432100, None),
        ("12.3400001", None, None), ("0.0000001", None, None), ("12.3400000", 1234, None), ("99999999999999999999", None, None), ("US$1", 100, "USD"), ("RM 2.5", 250, "MYR"),
    ],
)
def test_amounts(spark, printed, minor, currency):
    got = value(spark, money.parse_amount(F.col("a"), F.lit(None).cast("string")), a=printed)
    assert (got["minor"], got["currency"]) == (minor, currency)


@pytest.mark.parametrize("printed", ["n/a", "", "12x", "X 12", "1 2 3 USDX", "5.", "(", "S$"])
def test_no_amount_is_null(spark, printed):
    assert value(spark, money.parse_amount(F.col("a"), F.lit("SGD")), a=printed) is None


def test_minor_units_and_back(spark):
    assert value(spark, money.to_minor(F.col("a").cast("decimal(20,4)"), F.lit("KWD")), a="-7.1250") == -7125
    assert value(spark, money.to_minor(F.col("a").cast("decimal(20,4)"), F.lit("SGD")), a="7.1250") is None
    assert str(value(spark, money.from_minor(F.col("a").cast("long"), F.lit("SGD")), a="-905")) == "-9.050"


@pytest.mark.parametrize("minor, gate", [(0, 100), (300, 500), (299, 100), (-750, 1000), (9_999_999, 5_000_000)])
def test_gates_take_the_larger_of_two(spark, minor, gate):
    assert value(spark, money.gate(F.col("a").cast("long")), a=str(minor)) == gate


def test_dates(spark):
    assert value(spark, dates.full_date(F.col("a")), a="3 Sept 2025") == dt.date(2025, 9, 3)
    assert value(spark, dates.full_date(F.col("a")), a="31 Feb 2025") is None
    assert value(spark, dates.numeric_date(F.col("a")), a="01/12/21") == dt.date(2021, 12, 1)
    inside = lambda a, s, e: value(spark, dates.day_in_period(F.col("a"), F.col("s").cast("date"), F.col("e").cast("date")), a=a, s=s, e=e)
    assert inside("28 Dec", "2024-12-15", "2025-01-14") == dt.date(2024, 12, 28)
    assert inside("20/03", "2024-12-15", "2025-01-14") is None
    assert inside("01 Jan", "2024-01-01", "2025-01-02") is None
    p = value(spark, dates.period(F.col("a")), a="1 Jun 2025 - 30 June 2025")
    assert (p["start"], p["end"]) == (dt.date(2025, 6, 1), dt.date(2025, 6, 30))


def test_names(spark):
    d = value(spark, text.normalise_description(F.col("a")), a=" Señor  Größe;* 7 ")
    assert d == "SENOR GROßE * 7".upper()
    c = lambda a: value(spark, text.normalise_counterparty(F.col("a")), a=a)
    assert c("GIRO NORTH PIER INSURANCE QX7654321") == "NORTH PIER INSURANCE"
    assert c("BLUE KETTLE CAFE NA OTHER") == "BLUE KETTLE CAFE"
    assert c("FUNDS TRANSFER 55667788") == "FUNDS TRANSFER 55667788"
    assert c("KIOSK" + " SG" * 40) == "KIOSK" and c("KIOSK SG NA USA NA") == "KIOSK" and c("SG") == "SG"
    assert value(spark, text.card_numbers(F.col("a")), a="5500 0000 0000 0004 and 5500000000000004, 4000-1111-2222-3333") == ["XXXX-XXXX-XXXX-0004", "XXXX-XXXX-XXXX-3333"]
    assert value(spark, text.account_label(F.col("a"), F.col("b"), F.col("c")), a="BANK", b="12-3", c="") == "BANK 12-3"
    assert value(spark, text.clean_raw(F.col("a")), a="a\x01b\tc") == "a b\tc"
    assert value(spark, text.is_personal(F.col("a")), a="mr tan")
    assert not value(spark, text.is_personal(F.col("a")), a="TO: JOHN") and value(spark, text.is_personal(F.col("a")), a="TO:JOHN")
    assert value(spark, text.is_rail_name(F.col("a")), a="giro payments / collections via giro 99812")
    assert value(spark, text.mask_card(F.col("a")), a="card 4111 1111 1111 1234") == "XXXX-XXXX-XXXX-1234"


def tiny(spark, txns, links=(), hidden=(), paybacks=(), kinds=None):
    kinds = kinds or {}
    accounts = sorted({t[1] for t in txns})
    rows = [(i, None, a, d, m, "SGD", f"line {i}", "SHOP") for i, a, d, m in txns]
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    return Ledger(
        frame([(a, "BANK", f"{a:010d}", "SGD", kinds.get(a, "deposit")) for a in accounts], "account_id long, institution string, account_ref string, currency string, kind string"),
        frame(rows, "txn_id long, document_id long, account_id long, posted_date date, amount_minor long, currency string, description_raw string, counterparty_norm string"),
        frame([], "txn_id long, category string, source string"),
        frame([(h,) for h in hidden], "txn_id long"),
        frame([(*x, "manual") for x in links], "out_txn_id long, in_txn_id long, origin string"),
        frame(paybacks, "expense_txn_id long, income_txn_id long"),
        frame([], "document_id long, account_id long, period_start date, period_end date, opening_minor long, closing_minor long"),
    )


def test_base_leaves_out_transfers_hidden_and_paybacks(spark):
    l = tiny(  # noqa: E741
        spark, [(1, 1, day(0), -300), (2, 1, day(1), 60), (3, 1, day(2), -50), (4, 1, day(2), -70), (5, 2, day(3), 90), (6, 2, day(4), 0), (7, 1, day(4), 0)],
        links=[(3, None)], hidden=[4], paybacks=[(1, 2)], kinds={2: "card"},
    )
    ids = lambda d: {(r["txn_id"], r["effective"]) for r in spending.spending_base(l, d).collect()}
    assert ids("out") == {(1, -240)} and ids("in") == set() and ids("net") == {(1, -240), (7, 0)}


def test_paybacks_are_refused(spark):
    l = tiny(spark, [(1, 1, day(0), -300), (2, 1, day(1), 200), (3, 1, day(2), 200), (4, 1, day(2), 10)], hidden=[4])  # noqa: E741
    links = lambda *x: spark.createDataFrame(list(x), "expense_txn_id long, income_txn_id long")
    assert judgements.link_paybacks(l, links((1, 2)), "2026-01-01").count() == 1
    for bad in ([(1, 2), (1, 3)], [(1, 9)], [(2, 3)], [(1, 4)], [(1, 1)]):
        with pytest.raises(judgements.Refused):
            judgements.link_paybacks(l, links(*bad), "2026-01-01")
    with pytest.raises(judgements.Refused):
        judgements.link_paybacks(l, links(), "2026-01-01")


def test_last_entry_of_a_log_counts(spark):
    log = spark.createDataFrame([(1, "a", "2026-01-01", False), (1, "b", "2026-01-02", False), (2, "c", "2026-01-01", False), (2, None, "2026-01-03", True)], "txn_id long, category string, at string, deleted boolean")
    assert [tuple(r) for r in judgements.current(log, ["txn_id"]).collect()] == [(1, "b")]


def legs(spark, rows):
    schema = "txn_id long, account_id long, account_ref string, posted_date date, amount_minor long, description string, account_kind string, card_numbers array<string>"
    full = [(i, a, f"{a:010d}", d, m, *(more or ("", "deposit", []))) for i, a, d, m, more in rows]
    return spark.createDataFrame(full, schema)


def pairs(df):
    return sorted((r["out_txn_id"], r["in_txn_id"], r["evidence"]) for r in df.collect())


def test_transfers(spark):
    amount = transfers.EVIDENCE[3]
    same_day = [(1, 1, day(0), -100, None), (2, 2, day(0), 100, None)]
    assert pairs(transfers.find_transfers(legs(spark, same_day))) == [(1, 2, amount)]
    tie = [*same_day, (3, 3, day(0), 100, None)]
    assert pairs(transfers.find_transfers(legs(spark, tie))) == []
    assert transfers.ambiguous(legs(spark, tie), transfers.find_transfers(legs(spark, tie))).first()["candidates"] == [2, 3]
    named = [(1, 1, day(0), -100, ("to 00-0000-0002", "deposit", [])), (2, 2, day(20), 100, None), (3, 3, day(0), 100, None)]
    assert pairs(transfers.find_transfers(legs(spark, named))) == [(1, 2, transfers.EVIDENCE[0])]
    card = [(1, 1, day(0), -100, None), (2, 2, day(20), 100, ("", "card", []))]
    assert pairs(transfers.find_transfers(legs(spark, card))) == [(1, 2, transfers.EVIDENCE[2])]
    assert pairs(transfers.find_transfers(legs(spark, [(1, 1, day(0), -100, None), (2, 1, day(0), 100, None)]))) == []


def settled(rows, reach):
    """The pairing by plain lists: pass by pass, distance by distance, to a standstill."""
    outs, ins, done, links = [r for r in rows if r[3] < 0], [r for r in rows if r[3] > 0], set(), []
    for name, most in (("pays a card", reach.card_days), ("amount and date", reach.max_days)):
        for gap in range(most + 1):
            while True:
                free = [(o, i) for o in outs for i in ins if o[0] not in done and i[0] not in done and o[3] == -i[3] and o[1] != i[1] and abs((o[2] - i[2]).days) == gap and (name != "pays a card" or o[4] == "deposit" and i[4] == "card")]
                n, made = Counter(o[0] for o, _ in free), False
                for o, i in sorted(free, key=lambda p: (p[0][2], p[0][0], p[1][0])):
                    if n[o[0]] == 1 and o[0] not in done and i[0] not in done:
                        done |= {o[0], i[0]}
                        links.append((o[0], i[0], name))
                        made = True
                if not made:
                    break
    return sorted(links)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 40), st.sampled_from([-200, -100, 100, 200])), min_size=2, max_size=24), st.randoms())
def test_transfers_equal_brute_force_in_any_order(spark, drawn, rnd):
    kind = lambda a: "card" if a == 4 else "deposit"
    plain = [(n, a, day(d), m, kind(a)) for n, (a, d, m) in enumerate(drawn)]
    rows = [(i, a, d, m, ("", k, [])) for i, a, d, m, k in plain]
    rnd.shuffle(rows)
    assert pairs(transfers.find_transfers(legs(spark, rows))) == settled(plain, transfers.Reach())


def test_great_runs_settle_alike_by_rounds(spark):
    """One popular amount with legs on most days: by rounds of joins as by one task."""
    rng = random.Random(2)
    kind = lambda a: "card" if a == 4 else "deposit"
    plain = [(n, a, day(rng.randint(0, 60)), rng.choice([-100, 100]), kind(a)) for n, a in enumerate(rng.choices([1, 2, 3, 4], k=70))]
    rows = legs(spark, [(i, a, d, m, ("", k, [])) for i, a, d, m, k in plain])
    want = settled(plain, transfers.Reach())
    assert pairs(transfers.find_transfers(rows)) == want and pairs(transfers.find_transfers(rows, most_pairs=0)) == want


def test_charges_of_a_day_share_their_candidates(spark):
    """Days meet inflows, of which a day has no more than the limit; charges join what was found for their day."""
    import cairnledger.sources.driver_tables as tables

    l = tables.ledger(spark, "/root/testdata/sf0.01")
    charges = l.txn.where("amount_minor < 0 AND txn_id % 97 = 0").select("txn_id")
    income = [tuple(r) for r in spending.spending_base(l, "in").select("txn_id", "posted_date").collect()]
    dated = [tuple(r) for r in l.txn.join(charges, "txn_id", "left_semi").select("txn_id", "posted_date").collect()]
    near = lambda d, days, limit: sorted((abs((d - on).days), -i) for i, on in income if days is None or abs((d - on).days) <= days)[:limit]
    of_day = {(d, days): near(d, days, 5) for d in {d for _, d in dated} for days in (1, None)}
    for days in (1, None):
        found = spending.payback_candidates(l, charges, days=days, limit=5)
        want = sorted((c, *x) for c, d in dated for x in of_day[d, days])
        assert sorted((r["charge_id"], r["days_apart"], -r["txn_id"]) for r in found.collect()) == want
        assert "Window [row_number() windowspecdefinition(charge_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(posted_date" in found._jdf.queryExecution().executedPlan().toString()


def test_growth_knows_all_accounts(spark):
    from cairnledger.plans import registry
    from cairnledger.sources.driver_tables import ledger

    path = "/root/testdata/sf0.001"
    last = max(tuple(r) for r in registry.QUERIES["nw_04_growth"](spark, path).select("on", "accounts_known").collect())
    assert last[1] == ledger(spark, path).balance.select("account_id").distinct().count()


def test_series_pass_no_rows_through_the_driver(spark, monkeypatch):
    """Joins with what grows with the rows are dealt by key, however small they are estimated."""
    plans, keep = [], recurrence.settled
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(recurrence, "settled", lambda df: plan(df) or keep(df))
    rows = [(n, day(30 * n), -100, "PAYEE", "card payment") for n in range(5)] + [(9, day(3), -70, "GIRO", "giro")]
    plan(recurrence.find_series(spark.createDataFrame(rows, "txn_id long, posted_date date, amount_minor long, merchant string, description string")))
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_popular_amounts_form_no_pairs_by_days(spark, monkeypatch):
    """What is written on the way grows with the legs of an amount, not with their pairs; candidates are not dealt anew."""
    rng, kept = random.Random(5), []
    plain = [(n, rng.randint(1, 90), day(rng.randint(0, 9)), -100 if n % 2 else 100, "deposit") for n in range(600)] + [(900, 1, day(200), -100, "deposit"), (901, 2, day(203), 100, "deposit")]
    rows = legs(spark, [(i, a, d, m, ("", k, [])) for i, a, d, m, k in plain])
    keep = transfers.settled
    monkeypatch.setattr(transfers, "settled", lambda df: kept.append(df.count()) or keep(df))
    found = transfers.find_transfers(rows)
    linked = pairs(found)
    assert linked == settled(plain, transfers.Reach())
    want, gone = {}, {x for a, b, _ in linked for x in (a, b)}
    for o in (r for r in plain if r[3] < 0 and r[0] not in gone):
        apart = {i[0]: abs((o[2] - i[2]).days) for i in plain if i[3] > 0 and i[1] != o[1] and i[0] not in gone}
        nearest = min(apart.values())
        want[o[0]] = sorted(i for i, n in apart.items() if n == nearest)
    assert {r["txn_id"]: r["candidates"] for r in transfers.ambiguous(rows, found).collect()} == {o: i for o, i in want.items() if len(i) > 1}
    assert [tuple(r) for r in transfers.lone_pairs(rows).select("out_txn_id", "in_txn_id").collect()] == [(900, 901)]
    assert max(kept) <= 2 * len(plain)
    assert "Aggregate" not in transfers.candidates(rows)._jdf.queryExecution().executedPlan().toString()


def test_lone_pairs_have_one_candidate_by_any_evidence(spark):
    rng = random.Random(8)
    texts = ["", "", "", *(f"to {a:010d}" for a in range(1, 5))]
    rows = legs(spark, [(n, a, day(rng.randint(0, 700)), rng.choice([-1, 1]) * rng.choice([100, 200, 300]), (rng.choice(texts), "card" if a == 4 else "deposit", [])) for n, a in enumerate(rng.choices([1, 2, 3, 4], k=120))])
    for reach in (transfers.Reach(min_days=1, max_days=2, card_days=9),):
        found = [(r["out_txn_id"], r["in_txn_id"]) for r in transfers.candidates(rows, reach).collect()]
        outs, ins = Counter(o for o, _ in found), Counter(i for _, i in found)
        want = sorted((o, i) for o, i in found if outs[o] == ins[i] == 1)
        assert want
        assert sorted((r["out_txn_id"], r["in_txn_id"]) for r in transfers.lone_pairs(rows, reach).collect()) == want


def test_a_named_card_is_evidence(spark):
    rows = [(1, 1, day(0), -100, ("bill payment 4111 1111 1111 1234", "deposit", [])), (2, 2, day(25), 100, ("", "card", ["4000000000001234"])), (3, 3, day(1), 100, None)]
    assert pairs(transfers.find_transfers(legs(spark, rows))) == [(1, 2, transfers.EVIDENCE[1])]


def test_links_after_a_run(spark):
    stored = spark.createDataFrame([(1, 2, "auto"), (5, None, "manual")], "out_txn_id long, in_txn_id long, origin string")
    found = spark.createDataFrame([(3, 4)], "out_txn_id long, in_txn_id long")
    assert sorted(map(tuple, transfers.applied(stored, found).collect())) == [(3, 4, "auto"), (5, None, "manual")]
    assert sorted(map(tuple, transfers.rerun_diff(found, stored).collect())) == [(1, 2, "removed"), (3, 4, "added")]


def test_reach_refuses_nonsense():
    for bad in ({"min_days": -1}, {"min_days": 40}):
        with pytest.raises(ValueError):
            transfers.Reach(**bad)
    assert transfers.Reach.from_settings({"max_days": "6", "card_days": "many"}) == transfers.Reach(max_days=6)


def occurrences(spark, rows):
    return spark.createDataFrame([(n, d, m, name, line) for n, (d, m, name, line) in enumerate(rows)], "txn_id long, posted_date date, amount_minor long, merchant string, description string")


def found(spark, rows):
    rows = list(rows)
    random.Random(3).shuffle(rows)
    return [(r["merchant"], r["centre_minor"], r["period_label"], len(r["txn_ids"]), r["n_changes"]) for r in recurrence.find_series(occurrences(spark, rows)).orderBy("merchant", "centre_minor").collect()]


def test_recurrence(spark):
    monthly = [(day(30 * i), -1299, "STREAMFLIX", "") for i in range(6)]
    assert found(spark, monthly) == [("STREAMFLIX", 1299, "monthly", 6, 0)]
    assert found(spark, monthly[:2]) == []
    assert found(spark, [(day(47 * i), -1299, "ODD", "") for i in range(6)]) == []
    rise = [(day(30 * i), -999 if i < 4 else -1299, "STREAMFLIX", "") for i in range(8)]
    assert found(spark, rise) == [("STREAMFLIX", 1299, "monthly", 8, 1)]
    late_rise = [(day(30 * i), -999 if i < 5 else -1299, "STREAMFLIX", "") for i in range(7)]
    assert found(spark, late_rise) == [("STREAMFLIX", 1299, "monthly", 7, 1)]
    two_plans = [(day(30 * i + s), -500, "TELCO", "") for i in range(5) for s in (0, 12)]
    assert found(spark, two_plans) == [("TELCO", 500, "monthly", 5, 0)] * 2
    assert found(spark, [(d, m, "PAYNOW SHOP", "") for d, m, *_ in monthly]) == []
    ups = recurrence.find_series(occurrences(spark, rise))
    assert [tuple(r) for r in recurrence.price_rises(ups).collect()] == [("STREAMFLIX", "monthly", day(120), 999, 1299)]
    cost = recurrence.commitment(recurrence.status(ups, day(220))).first()
    assert tuple(cost) == (1, 1299)
    debit = "GIRO Payments / Collections via GIRO PACS"
    rails = [(day(30 * i), -8800, "PACS BNC" if i % 2 else "ACME LIFE PACS BNC", debit) for i in range(4)]
    assert found(spark, rails) == [("PACS BNC", 8800, "monthly", 4, 0)]
    # A new price under a bare rail goes on with the merchant's series.
    dearer = [(day(30 * i), -9900, "ACME", debit) for i in range(4)] + [(day(120 + 30 * i), -12900, "ACME" if i == 0 else "GIRO", debit) for i in range(4)]
    assert found(spark, dearer) == [("ACME", 12900, "monthly", 8, 1)]
    # Amounts far apart at one merchant, in any number, keep apart.
    many = [(day(30 * i), -m, "STORE", "") for m in (100, 1000, 20000) for i in range(4)]
    assert found(spark, many) == [("STORE", m, "monthly", 4, 0) for m in (100, 1000, 20000)]
    assert found(spark, [(d, m, "GIRO", debit) for d, m, *_ in rails]) == [(recurrence.UNNAMED, 8800, "monthly", 4, 0)]


def test_statement_checks(spark):
    s = "doc string, account_id long, opening_minor long, closing_minor long, declared_out long, declared_in long, declared_count long, period_start date, period_end date, grace_days int"
    r = "doc string, account_id long, pos long, posted_date date, value_date date, amount_minor long, column_sign int, section string"
    rows = lambda doc, *x: [(doc, 1, n, d, None, m, None, "") for n, (d, m) in enumerate(x)]
    declared = [
        ("good", 1, 100, 70, 40, 10, 2, day(0), day(9), 0), ("off", 1, 100, 80, None, None, None, day(0), day(9), 0), ("open", 1, None, 70, None, None, None, day(0), day(9), 0),
        ("late", 1, 0, 5, None, None, None, day(0), day(9), 2), ("order", 1, 0, 3, None, None, None, day(0), day(9), 0), ("count", 1, 0, 5, None, None, 2, day(0), day(9), 0),
        ("empty", 1, 7, 7, None, None, None, day(0), day(9), 0),
    ]
    data = [
        *rows("good", (day(5), -40), (day(3), 10)), *rows("off", (day(1), -40), (day(3), 10)), *rows("open", (day(1), -40)), *rows("late", (day(12), 5)),
        *rows("order", (day(1), 1), (day(5), 1), (day(2), 1)), *rows("count", (day(1), 5)),
    ]
    data = spark.createDataFrame(data, r)
    checked = statements.validate(spark.createDataFrame(declared, s), data)
    assert {x["doc"]: (x["status"], x["failed"]) for x in checked.collect()} == {
        "good": ("imported", []), "off": ("quarantined", ["balance"]), "open": ("imported_unverified", []), "late": ("quarantined", ["dates"]),
        "order": ("quarantined", ["order"]), "count": ("quarantined", ["count"]), "empty": ("imported", []),
    }
    assert [(x["pos"], x["hint"]) for x in statements.difference_hints(checked, data).collect()] == [(1, "row equals difference")]


def test_documents_are_judged_whole(spark):
    s = "doc string, account_id long, opening_minor long, closing_minor long, declared_out long, declared_in long, declared_count long, period_start date, period_end date, grace_days int"
    r = "doc string, account_id long, pos long, posted_date date, value_date date, amount_minor long, column_sign int, section string"
    declared = [("two", 1, 0, 5, None, None, 2, day(0), day(9), 0), ("two", 2, 0, 7, None, None, 2, day(0), day(9), 0), ("half", 1, 0, 5, None, None, None, day(0), day(9), 0),
                ("half", 2, 0, 9, None, None, None, day(0), day(9), 0), ("back", 1, None, None, 35, 0, None, day(0), day(9), 0), ("mixed", 1, 0, 1, None, None, None, day(0), day(9), 0),
                ("mixed", 2, None, 1, None, None, None, day(0), day(9), 0)]
    rows = [("two", 1, 1, day(1), None, 5, None, ""), ("two", 2, 2, day(1), None, 7, None, ""), ("half", 1, 1, day(1), None, 5, None, ""), ("half", 2, 2, day(1), None, 8, None, ""),
            ("back", 1, 1, day(1), None, -40, -1, ""), ("back", 1, 2, day(2), None, 5, -1, ""), ("mixed", 1, 1, day(1), None, 1, None, "")]
    got = statements.validate(spark.createDataFrame(declared, s), spark.createDataFrame(rows, r))
    assert sorted((x["doc"], x["account_id"], x["status"], x["failed"]) for x in got.collect()) == [
        ("back", 1, "imported_unverified", []), ("half", 1, "quarantined", []), ("half", 2, "quarantined", ["balance"]), ("mixed", 1, "imported_unverified", []),
        ("mixed", 2, "imported_unverified", []), ("two", 1, "imported", []), ("two", 2, "imported", []),
    ]


def test_movement_follows_the_document(spark):
    """A statement of a month, and a row that was posted after its end."""
    l = tiny(spark, [])  # noqa: E741
    txn = spark.createDataFrame([(1, 9, 1, day(2), 10), (2, 9, 1, day(19), 20), (3, 9, 1, day(31), 5), (4, 8, 1, day(3), 7)], "txn_id long, document_id long, account_id long, posted_date date, amount_minor long")
    balance = spark.createDataFrame([(9, 1, day(0), day(29), 0, 35)], "document_id long, account_id long, period_start date, period_end date, opening_minor long, closing_minor long")
    moved = spending.daily_movement(dataclasses.replace(l, txn=txn, balance=balance))
    assert sorted(map(tuple, moved.collect())) == [(1, day(2), 10), (1, day(19), 20), (1, day(29), 5)]


def test_drift_and_worth(spark):
    b = spark.createDataFrame([(1, 1, day(0), day(6), 0, 100), (2, 1, day(7), day(13), 90, 150), (3, 2, day(0), day(6), 0, -30)], "document_id long, account_id long, period_start date, period_end date, opening_minor long, closing_minor long")
    m = spark.createDataFrame([(1, day(3), 100), (1, day(8), 20), (1, day(13), 20), (1, day(14), 5)], "account_id long, day date, moved_minor long")
    assert sorted((r["kind"], r["expected_minor"], r["actual_minor"]) for r in statements.drifts(b, m).collect()) == [("continuity", 100, 90), ("movement", 50, 40)]
    assert tuple(statements.clean(statements.drifts(b, m)).first()) == (False, 1, 1)
    assert [tuple(r) for r in statements.growth(b, day(0)).collect()] == [(day(13), 120, 2)]
    assert [tuple(r) for r in statements.growth(b, day(0), every="statement").orderBy("on").collect()] == [(day(6), 70, 2), (day(13), 120, 2)]
    assert [tuple(r) for r in statements.growth(b, day(7)).collect()] == [(day(13), 150, 1)]  # what ended before the window is not known in it
    assert statements.growth_since(dt.date(2026, 6, 1), 31) == dt.date(2026, 6, 1) - dt.timedelta(days=961)
    assert [tuple(r) for r in statements.net_worth(b).orderBy("on").collect()] == [(day(6), 70, 2), (day(13), 120, 2)]


def test_inserting_twice_appends_nothing(spark):
    l = ledger(spark, SF)  # noqa: E741
    rows = derived.keyed_rows(l)
    first = identity.complement(rows, rows.limit(0))
    assert first.count() == rows.select("dedupe_key").distinct().count() == rows.count()
    assert identity.complement(rows, first).count() == 0
    assert identity.content_compare(rows, first).count() == 0
    digests = identity.content_digest(rows)
    assert identity.content_digest(rows.orderBy(F.rand())).exceptAll(digests).count() == 0


def test_arrivals(spark):
    new = spark.createDataFrame([("f1", "s1", "c"), ("f2", "s1", "c1"), ("f3", "s1", "c9"), ("f4", "s4", "c")], "sha256 string, statement_key string, content string")
    stored = spark.createDataFrame([("f1", "s1", "c1")], "sha256 string, statement_key string, content string")
    assert {r["sha256"]: r["fate"] for r in identity.arrival(new, stored).collect()} == {"f1": "known", "f2": "duplicate", "f3": "conflicting", "f4": "new"}


def test_votes_and_rules(spark):
    v = spark.createDataFrame([("a", "X", "Dining"), ("b", "X", "Dining"), ("c", "X", "Travel"), ("a", "Y", "Dining"), ("b", "Y", "Bogus")], "model string, name string, category string")
    got = {r["name"]: tuple(r)[1:] for r in categories.consolidate(v).collect()}
    assert got == {"X": ("Dining", 2, 3, True, "Travel:c"), "Y": ("Dining", 1, 1, False, "")}
    pattern, _, weight, _ = categories.operator_rule("A.B (C)", "Dining")
    assert categories.literal_of(pattern) == "A.B (C)" and weight == 100 and categories.literal_of("^a.*$") is None
    proposals = categories.propose(
        spark.createDataFrame([("SHOP", -500, "pos SHOP 1"), ("SHOP", -700, "pos SHOP 1"), ("JANE", -1, "PAYNOW TO JANE"), ("GRABPAY", -1, "x")], "name string, amount_minor long, description string"),
        derived.part_rules(spark).limit(0), derived.part_rules(spark),
    )
    assert [tuple(r) for r in proposals.collect()] == [("SHOP", 2, 500, 1200, None, "POS SHOP #")]


def test_lines_and_rows(spark):
    w = spark.createDataFrame([("d", 1, 50.0, 60.0, 100.0, "a"), ("d", 1, 70.0, 80.0, 103.0, "b"), ("d", 1, 50.0, 60.0, 105.0, "c")], "doc string, page int, x0 double, x1 double, top double, text string")
    assert [(r["line"], r["text"]) for r in geometry.lines(w).orderBy("line").collect()] == [(0, "a b"), (1, "c")]


def plain_rows(lines, gap):
    """Rows from lines (page, line, top, text, value) one after another."""
    rows, waiting, last = [], [], None
    near = lambda a, b: a[0] == b[0] and b[1] > a[1] and (gap is None or b[1] - a[1] <= gap)
    for page, _, top, words, has in lines:
        if has:
            rows.append([t for at, t in waiting if near(at, (page, top))] + [words])
            waiting, last = [], (page, top)
        elif last and near(last, (page, top)):
            rows[-1].append(words)
            last = (page, top)
        else:
            waiting.append(((page, top), words))
    return [" ".join(r) for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([0.0, 3.0, 8.0, 9.0, 12.0, 40.0]), st.booleans()), max_size=8), min_size=1, max_size=3), st.sampled_from([9.0, None]))
def test_rows_equal_brute_force(spark, pages, gap):
    lines = []
    for p, page in enumerate(pages):
        top = 20.0
        for n, (step, has) in enumerate(page):
            top += step
            lines.append((p, n, top, f"t{len(lines)}", has))
    df = spark.createDataFrame([("d", *x) for x in lines], "doc string, page int, line int, top double, text string, value boolean")
    got = [r["description"] for r in layout.rows_of(df, gap).orderBy("pos").collect()]
    if all(step > 0 for page in pages for step, _ in page):
        assert got == plain_rows(lines, gap)
    assert len(got) == sum(has for *_, has in lines)


def test_statement_by_a_layout(spark):
    """A page with a header, wrapped descriptions, furniture, marginal print and both money columns."""
    w = lambda x0, x1, t: (x0, x1, t)
    page = [
        (10.0, [w(50, 80, "ACME"), w(90, 120, "Bank")]),
        (30.0, [w(50, 75, "Date"), w(120, 180, "Particulars"), w(300, 350, "Debit"), w(380, 425, "Credit"), w(460, 510, "Balance")]),
        (50.0, [w(50, 75, "01/06"), w(120, 160, "GIRO"), w(165, 290, "NORTHPIER"), w(320, 352, "12.50"), w(470, 511, "87.50")]), (58.0, [w(120, 170, "POLICY"), w(2, 8, "geR")]),
        (66.0, [w(120, 150, "SEVEN")]), (90.0, [w(120, 160, "SALARY")]), (98.0, [w(50, 75, "02/06"), w(120, 150, "JUNE"), w(390, 427, "1,000.00"), w(465, 511, "1,087.50")]),
        (120.0, [w(50, 80, "Page"), w(90, 95, "1")]), (140.0, [w(50, 75, "03/06"), w(120, 150, "BOTH"), w(320, 352, "1.00"), w(390, 427, "2.00")]),
    ]
    rows = [("d", 1, n, top, [(float(a), float(b), t) for a, b, t in words]) for n, (top, words) in enumerate(page)] + [("none", 1, 0, 1.0, [(1.0, 2.0, "Date")])]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, top double, words array<struct<x0:double,x1:double,text:string>>")
    found = layout.statement_rows(lines, layout.DEPOSIT)
    got = [tuple(r) for r in layout.signed_amounts(found, layout.DEPOSIT).orderBy("pos").collect()]
    assert got == [("d", 1, "01/06 GIRO NORTHPIER POLICY SEVEN", "12.50", -1), ("d", 2, "SALARY 02/06 JUNE", "1,000.00", 1), ("d", 3, "03/06 BOTH", None, None)]
    assert [r["cells"]["balance"] for r in found.orderBy("pos").collect()] == ["87.50", "1,087.50", ""]


def test_routing(spark):
    docs = spark.createDataFrame([("a", ["x", "y"], ["p"], 600.0, 800.0), ("b", ["x", "y", "z"], ["p"], 600.0, 800.0), ("c", ["q"], [], 600.0, 800.0), ("e", [], ["q"], 600.0, 800.0)], "doc string, labels array<string>, tokens array<string>, width double, height double")
    sig = spark.createDataFrame([("one", ["x", "y"], ["p"], 605.0, 800.0), ("two", ["z"], ["p"], 600.0, 800.0), ("bare", [], ["q"], 600.0, 800.0)], "layout string, requires array<string>, producer array<string>, width double, height double")
    assert {r["doc"]: (r["layout"], r["fate"]) for r in geometry.routed(docs, sig).collect()} == {"a": ("one", "routed"), "b": (None, "ambiguous"), "c": (None, "unknown"), "e": ("bare", "routed")}


def test_renamed_vendors_are_learned(spark):
    schema = "doc string, labels array<string>, tokens array<string>, width double, height double"
    docs = spark.createDataFrame([("old", ["x"], ["p"], 600.0, 800.0), ("new", ["x", "y"], ["q"], 600.0, 800.0), ("odd", ["z"], ["q"], 600.0, 800.0)], schema)
    sig = spark.createDataFrame([("one", ["x"], ["p"], 600.0, 800.0), ("two", ["x", "y"], ["p"], 600.0, 800.0)], "layout string, requires array<string>, producer array<string>, width double, height double")
    maybe = geometry.rename_candidates(docs, sig)
    assert sorted(map(tuple, maybe.collect())) == [("new", "one"), ("new", "two")]
    read = lambda *rows: spark.createDataFrame(list(rows), "doc string, layout string, status string")
    assert geometry.healed(maybe, read(("new", "one", "imported"), ("new", "two", "imported"))).count() == 0
    won = geometry.healed(maybe, read(("new", "one", "quarantined"), ("new", "two", "imported")))
    assert [tuple(r) for r in won.collect()] == [("new", "two")]
    assert {r["doc"]: r["layout"] for r in geometry.routed(docs, geometry.learned(won, docs, sig)).collect()} == {"old": "one", "new": "two", "odd": None}


def test_rates_belong_to_the_row_above(spark):
    w = lambda x0, x1, t: (float(x0), float(x1), t)
    head = [w(50, 75, "Date"), w(120, 180, "Transaction"), w(300, 350, "Foreign"), w(400, 450, "Amount")]
    page = [
        (30.0, head), (50.0, [w(120, 180, "NOODLE BAR")]), (58.0, [w(50, 75, "01/06"), w(300, 345, "USD9.00"), w(410, 450, "12.10")]), (66.0, [w(120, 200, "1 USD = SGD 1.3444")]),
        (90.0, [w(50, 75, "02/06"), w(120, 160, "TEA"), w(420, 450, "3.00")]), (98.0, [w(120, 160, "HOUSE")]),
    ]
    rows = [("d", 1, n, top, words) for n, (top, words) in enumerate(page)]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, top double, words array<struct<x0:double,x1:double,text:string>>")
    got = layout.statement_rows(lines, layout.SAVINGS).orderBy("pos").collect()
    assert [(r["description"], r["rate_currency"], None if r["rate"] is None else str(r["rate"])) for r in got] == [("NOODLE BAR 01/06 USD9.00", "USD", "1.34440000"), ("02/06 TEA HOUSE", None, None)]


def test_fingerprints_of_layouts(spark):
    docs = spark.createDataFrame([("a", "Maker 1.2", 595.2, 842.0), ("b", "maker 3", 595.0, 841.9), ("c", "Other", 595.0, 842.0), ("d", "Maker", 595.0, 842.0)], "doc string, producer string, width double, height double")
    rows = [(d, 1, 0, 20.0, "Statement  of Account") for d in "abc"] + [(d, 1, 1, 40.0, f"No {n}") for n, d in enumerate("abcd")] + [("a", 1, 2, 800.0, "Footer")]
    keys = {r["doc"]: r["layout_key"] for r in geometry.layout_fingerprints(spark.createDataFrame(rows, "doc string, page int, line int, top double, text string"), docs).collect()}
    assert keys["a"] == keys["b"] and len(set(keys.values())) == 3
    assert [value(spark, text.safe_file_name(F.col("a")), a=n) for n in ("../x/My file?.pdf", "...", "C:\\tmp\\a b.csv")] == ["My_file_.pdf", "file", "a_b.csv"]


def test_files_and_archive(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, data in (("in/a.pdf", b"%PDF-1"), ("in/deep/b.PDF", b"%PDF-2"), ("in/c.pdf", b"%PDF-1"), ("in/d.exe", b"MZ")):
        (tmp_path / name).write_bytes(data)
    seen = files.discover(spark, str(tmp_path / "in"))
    assert seen.count() == 3 and {r["format"] for r in seen.collect()} == {"pdf"}
    for _ in range(2):
        files.put_originals(seen, str(tmp_path / "blobs"))
    assert files.originals(spark, str(tmp_path / "blobs")).count() == 2
    l = ledger(spark, SF)  # noqa: E741
    tables = {"txn": l.txn, "hidden": l.hidden}
    archive.backup(tables, str(tmp_path / "backup"))
    back = archive.restore(spark, str(tmp_path / "backup"), {"txn": l.txn.limit(0)})
    assert back["txn"].exceptAll(l.txn).count() == 0 == l.txn.exceptAll(back["txn"]).count()
    with pytest.raises(ValueError):
        archive.restore(spark, str(tmp_path / "backup"), {"txn": l.txn})


def test_stream_inserts_once(spark, tmp_path):
    rows = derived.keyed_rows(ledger(spark, SF))
    inbox, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows.write.parquet(inbox)
    for n in (1, 2):
        intake.stream_rows(spark, inbox, rows.schema, table, str(tmp_path / f"state{n}"), lambda b: b).awaitTermination()
    assert spark.read.parquet(table).count() == rows.count()


def test_decisions_by_category_id(spark):
    schema = "rule_id long, pattern string, category_id long, weight int, literal string, note string"
    rules = spark.createDataFrame([(1, "KIOSK", 1, 0, None, "seed"), (2, "^A B$", 1, 100, "A B", "decided by operator")], schema)
    after = categories.decide(rules, spark.createDataFrame([("A B", 2), ("C.D", 1)], "name string, category_id long"))
    names = spark.createDataFrame([(1, "Eating"), (2, "Moving")], "category_id long, name string")
    listed = [tuple(r)[:4] for r in categories.named_rules(after, names).collect()]
    assert listed == [(3, "^A\\ B$", "Moving", 100), (4, "^C\\.D$", "Eating", 100), (1, "KIOSK", "Eating", 0)]
    assert categories.without_decision(after, spark.createDataFrame([("a b",)], "name string")).count() == 2
    assert categories.seed(names, names.where("category_id = 1"), "category_id").collect()[0]["name"] == "Moving"
    judged = categories.categorise(spark.createDataFrame([("A B",), ("C.D",), ("CXD",)], "name string"), categories.named_rules(after, names))
    assert {r["name"]: r["category"] for r in judged.collect()} == {"A B": "Moving", "C.D": "Eating", "CXD": "Others"}


def test_first_appearances_accounts_and_cards(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 3), ("b", 1), ("a", 4)], "k string, n int")
    assert [tuple(r) for r in identity.first_of_each(rows, ["k"], "n").collect()] == [("b", 1), ("a", 3)]
    stored = spark.createDataFrame([("x", "BANK", "card")], "account_key string, institution string, kind string")
    more = spark.createDataFrame([("x", "OTHER", "card"), ("y", "BANK", "deposit"), ("y", "BANK", "deposit")], stored.schema)
    assert [tuple(r) for r in identity.new_accounts(more, stored).collect()] == [("y", "BANK", "deposit")]
    l = tiny(spark, [(1, 1, day(0), -5), (2, 2, day(1), 5)])  # noqa: E741
    cards = spark.createDataFrame([(2, "4000000000001234")], "account_id long, number string")
    assert {r["account_id"]: r["card_numbers"] for r in transfers.legs_of(l, cards).collect()} == {1: [], 2: ["4000000000001234"]}


def test_reports_and_series_logs(spark):
    checked = spark.createDataFrame([("d", 77771234, "quarantined", ["balance", "order"], -10), ("d", 5, "quarantined", [], 0)], "doc string, account_id long, status string, failed array<string>, difference long")
    rows = spark.createDataFrame([("d", 77771234, 3, 10), ("d", 77771234, 4, 5)], "doc string, account_id long, pos long, amount_minor long")
    assert [tuple(r) for r in statements.failure_report(checked, rows).collect()] == [("d", "account 1234: balance, order by -10 (row 3: row equals difference; row 4: row equals half of it)")]
    series = spark.createDataFrame([("ACME", 500)], "merchant string, centre_minor long")
    log = judgements.dismissed_series(series, "2026-01-01").unionByName(judgements.dismissed_series(series, "2026-01-02", restore=True))
    keys = ["merchant", "centre_minor"]
    assert judgements.current(log, keys).count() == 0 and judgements.current(log.where("NOT deleted"), keys).count() == 1
    marks = judgements.marked_series(spark.createDataFrame([("ACME", 500, "monthly")], "merchant string, centre_minor long, period_label string"), "2026-01-01")
    seen = occurrences(spark, [(day(0), -500, "ACME", ""), (day(31), -520, "ACME", ""), (day(40), -900, "ACME", "")])
    got = recurrence.declared_series(seen, judgements.current(marks, keys)).first()
    assert (got["n_rows"], got["total_minor"], got["expected_next"]) == (2, 1020, day(61))
    assert recurrence.without_dismissed(series, judgements.current(log.where("NOT deleted"), keys)).count() == 0
    found = recurrence.find_series(occurrences(spark, [(day(30 * i), -500, "ACME", "") for i in range(4)]))
    marked = found.limit(1).withColumn("txn_ids", F.array(F.lit(0).cast("long")))
    assert recurrence.with_marks(found, marked).count() == 1


def test_judgement_entries(spark):
    l = tiny(spark, [(1, 1, day(0), -300), (2, 1, day(1), 200)], paybacks=[(1, 2)])  # noqa: E741
    ids = spark.createDataFrame([(1,)], "txn_id long")
    log = judgements.hide(ids, "2026-01-01").unionByName(judgements.unhide(ids, "2026-01-02"))
    assert judgements.current(log, ["txn_id"]).count() == 0
    assert [tuple(r)[:2] for r in judgements.unlink_paybacks(l, 1, "2026-01-01").collect()] == [(1, 2)]
    assert judgements.unlink_paybacks(l, 1, "2026-01-01", income_txn_id=9).count() == 0
    marks = spark.createDataFrame([(1, None)], "out_txn_id long, in_txn_id long")
    assert judgements.mark_transfers(l, marks, "2026-01-01").first()["origin"] == "manual"
    with pytest.raises(judgements.Refused):
        judgements.mark_transfers(l, spark.createDataFrame([(1, 1)], marks.schema), "2026-01-01")
    chosen = judgements.set_categories(spark.createDataFrame([(1, "Dining"), (2, None)], "txn_id long, category string"), "2026-01-01")
    assert {r["txn_id"]: r["deleted"] for r in chosen.collect()} == {1: False, 2: True}
    kept = judgements.save_settings(spark.createDataFrame([("max_days", "4"), ("card_days", "9")], "key string, value string"), spark.createDataFrame([("max_days", "4")], "key string, value string"), "2026-01-01")
    assert {r["key"]: r["deleted"] for r in kept.collect()} == {"max_days": True, "card_days": False}


def test_letters_and_lists_of_files(spark, tmp_path):
    bad = spark.createDataFrame([("f1", "parse_failed", ("x",)), ("f2", "parse_failed", ("y",))], "sha256 string, reason string, detail struct<a:string>")
    letters = files.dead_letters(bad)
    assert [tuple(r) for r in files.queue_depth(letters, letters.where("sha256 = 'f1'")).collect()] == [("parse_failed", 1)]
    for name, told in (("ada-1.json", '{"X": "Dining"}'), ("ada-2.json", '{"X": "Travel"}'), ("bo.json", '{"X": "Dining"}')):
        (tmp_path / name).write_text(told)
    assert {(r["model"], r["category"]) for r in files.model_votes(spark, str(tmp_path)).collect()} == {("ada", "Travel"), ("bo", "Dining")}
    found = spark.createDataFrame([(f"p{i}", "s", "pdf", i) for i in range(5)], "path string, sha256 string, format string, length long")
    assert [(r["path"], r["n_all"]) for r in files.listing(found, 2).collect()] == [("p0", 5), ("p1", 5)]


def test_documents_and_windows_of_streams(spark, tmp_path):
    inbox, table = tmp_path / "inbox", str(tmp_path / "documents")
    inbox.mkdir()
    for name, data in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-2"), ("c.pdf", b"%PDF-1")):
        (inbox / name).write_bytes(data)
    for _ in range(2):
        intake.stream_documents(spark, str(inbox), table, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    at = lambda m: dt.datetime(2026, 6, 1, 10, m)
    events = spark.createDataFrame([(at(1), "x", 1.0), (at(59), "x", 2.0), (at(30), "y", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in intake.windowed_totals(events).collect()) == [("x", 2, 3.0), ("y", 1, 4.0)]


def test_widths_and_currencies(spark):
    assert [spending.bucket_width(day(0), day(n)) for n in (0, 13, 14, 363, 364)] == ["day", "day", "week", "week", "month"] and spending.bucket_width(None, day(1)) == "month"
    l = tiny(spark, [(1, 1, day(0), -5), (2, 1, day(1), 5)])  # noqa: E741
    assert spending.single_currency(l) == "SGD"
    mixed = l.txn.withColumn("currency", F.when(F.col("txn_id") == 1, "USD").otherwise("SGD"))
    with pytest.raises(ValueError):
        spending.single_currency(dataclasses.replace(l, txn=mixed))


def test_consensus_and_money_columns(spark):
    verdicts = spark.createDataFrame([("A.B", "Dining", False), ("C", "Others", False), ("D", "Travel", True)], "name string, category string, needs_review boolean")
    rules = categories.consensus_rules(verdicts)
    assert [tuple(r) for r in rules.collect()] == [("^A\\.B$", "Dining", 0, "A.B")]
    words = spark.createDataFrame([(352.0,), (420.0,), (600.0,)], "x1 double")
    assert [r["column"] for r in geometry.money_cell(words, [("out", 350.0), ("in", 425.0)]).orderBy("x1").collect()] == ["out", "in", None]


def test_rows_of_removed_and_reread_documents(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "txn": frame([(1, 8), (2, 9)], "txn_id long, document_id long"), "balance": frame([(8,), (9,)], "document_id long"), "hidden": frame([(1,), (2,)], "txn_id long"),
        "transfer_link": frame([(1, 2), (2, None)], "out_txn_id long, in_txn_id long"), "payback": frame([(1, 2)], "expense_txn_id long, income_txn_id long"), "rule": frame([("x",)], "pattern string"),
    }
    left = judgements.without_documents(tables, frame([(8,)], "document_id long"))
    assert {n: df.count() for n, df in left.items()} == {"txn": 1, "balance": 1, "hidden": 1, "transfer_link": 1, "payback": 0, "rule": 1}
    keyed = "txn_id long, dedupe_key string"
    restored, dropped = judgements.reapplied(frame([(1, "Dining"), (2, "Travel")], "old_id long, category string"), frame([(1, "k1"), (2, "k2")], keyed), frame([(7, "k1")], keyed))
    assert [(r["txn_id"], r["category"]) for r in restored.collect()] == [(7, "Dining")] and [r["category"] for r in dropped.collect()] == ["Travel"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_cut_once_and_rows_are_dealt_once(spark):
    lines = derived.printed_statements(spark, SF)
    assert plan(layout.marked(layout.cut(lines, layout.header_columns(lines, layout.DEPOSIT)), layout.DEPOSIT)).count("map_from_arrays") == 1
    assert plan(layout.statement_rows(lines, layout.DEPOSIT)).count("map_from_arrays") == 1
    printed = spark.createDataFrame([("d", 1, 0, 1.0, "lead", False), ("d", 1, 1, 2.0, "row", True), ("d", 1, 2, 50.0, "far", False), ("d", 2, 0, 1.0, "other", True)], "doc string, page int, line int, top double, text string, value boolean")
    rows = layout.rows_of(printed, carry=("value",))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [("d", 1, 1, 1, 2.0, "lead row", True), ("d", 2, 2, 0, 1.0, "other", True)]


def test_headers_are_dealt_and_not_broadcast(spark):
    lines = derived.printed_statements(spark, SF)
    assert "Broadcast" not in layout.statement_rows(lines, layout.DEPOSIT)._jdf.queryExecution().executedPlan().toString()


def test_patterns_meet_names_and_not_rows(spark):
    rows = spark.range(9).selectExpr("concat('SHOP', ' ' || id % 2) AS name", "-id AS amount_minor", "'pos SHOP' AS description")
    rules = derived.part_rules(spark).limit(0)
    assert "Range" not in plan(categories.review_queue(rows, rules))
    assert [tuple(r) for r in categories.review_queue(rows, rules).select("name", "n_rows", "value_minor").collect()] == [("SHOP 0", 5, 20), ("SHOP 1", 4, 16)]
    assert plan(categories.propose(rows, rules, rules)).count("Range") == 2  # for the median only


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 3), st.integers(0, 2**40))), min_size=1, max_size=30))
def test_upper_medians(spark, rows):
    made = categories.upper_median_by(spark.createDataFrame(rows, "k string, v long"), "k", "v")
    order = lambda v: (v is not None, v)
    want = {k: sorted((v for x, v in rows if x == k), key=order) for k in {k for k, _ in rows} - {None}}
    assert {tuple(r) for r in made.collect()} == {(k, v[len(v) // 2]) for k, v in want.items()}
    assert "row_number" not in plan(made)


def test_lines_of_a_form_are_cut_without_a_join(spark):
    form = statement_forms.FORMS["two dates"]
    lines, _ = derived.printed_documents(spark, SF)
    content = grouped.settled(forms.sectioned(lines.where("doc % 2 = 1").withColumn("t", forms.line_text(F.col("words"))), form))
    rows = forms.assembled(content, form, "", form.tables[""])
    assert "Join" not in plan(rows) and rows.limit(1).count() == 1


def test_headers_of_a_form_are_dealt_and_lines_kept_without_them(spark):
    form = statement_forms.FORMS["two dates"]
    lines, _ = derived.printed_documents(spark, SF)
    content = forms.sectioned(grouped.stored(lines.where("doc % 2 = 1")).withColumn("t", forms.line_text(F.col("words"))), form)
    assert "Broadcast" not in content._jdf.queryExecution().executedPlan().toString()
    assert "columns" not in content.columns and "cells" in content.columns  # a header's columns are not written again with every line


def test_orders_of_cards_are_dealt_and_not_broadcast(spark):
    assert "Broadcast" not in registry.win_12_card_sightings(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_the_same_by_parts_too(spark):
    rows = spark.createDataFrame([("2024", 1), ("two dates", 2), ("two dates", None)], "layout string, n int")
    kept = grouped.stored(rows, "layout")
    assert kept.schema["layout"].dataType == rows.schema["layout"].dataType and sorted(map(str, kept.select("layout", "n").collect())) == sorted(map(str, rows.collect()))
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def dealt_once(df):
    """Whether rows are dealt once, and not grouped before."""
    _, *below = df._jdf.queryExecution().executedPlan().toString().split("Exchange ")
    return len(below) == 1 and "Aggregate" not in below[0]


def test_words_are_dealt_once_for_cells(spark):
    assert dealt_once(geometry.cells(derived.placed_words(spark, SF), derived.BANDS))
    odd = [("d", 1, 20.0, -0.0, "b"), ("d", 1, 10.0, 0.0, "a"), ("d", 1, 95.0, 0.0, "c"), ("d", 2, 20.0, 0.0, None), (None, 1, 20.0, None, "n"), ("d", 1, None, 0.0, "out"), ("d", 1, 200.0, 0.0, "out")]
    words = spark.createDataFrame(odd, "doc string, page int, x0 double, top double, text string").repartition(3)
    got = {tuple(r) for r in geometry.cells(words, [("low", 0.0, 50.0), ("high", 40.0, 100.0), ("low", 90.0, 99.0)]).collect()}
    assert got == {("d", 1, 0.0, "low", "a b c"), ("d", 2, 0.0, "low", ""), (None, 1, None, "low", "n")}
    assert geometry.cells(words, []).count() == 0


def test_words_are_dealt_once_for_lines(spark):
    assert dealt_once(geometry.lines(derived.placed_words(spark, SF)))
    odd = [("d", 1, 10.0, 8.5, "c"), ("d", 1, 30.0, 0.0, "b"), ("d", 1, 20.0, 4.0, "a"), ("d", 1, None, 4.5, None), ("d", 1, 5.0, 4.5, "x"), ("d", 1, 1.0, None, "no height"), ("d", 2, 1.0, 3.0, None), (None, 1, 1.0, 1.0, "n")]
    words = spark.createDataFrame(odd, "doc string, page int, x0 double, top double, text string").repartition(3)
    want = {("d", 1, -1, None, "no height"), ("d", 1, 0, 0.0, "a b"), ("d", 1, 1, 4.5, "x c"), ("d", 2, 0, 3.0, ""), (None, 1, 0, 1.0, "n")}
    assert {tuple(r) for r in geometry.lines(words).collect()} == want
