"""Cases in which an answer was, or could easily be, another than it should be."""

import dataclasses
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnledger.operators import categories, layout, recurrence, spending, statements, transfers
from tests.test_ledger import day, legs, tiny


def offered(l, charge, **more):  # noqa: E741
    charges = l.txn.sparkSession.createDataFrame([(c,) for c in ([charge] if isinstance(charge, int) else charge)], "txn_id long")
    return [(r["charge_id"], r["txn_id"]) for r in spending.payback_candidates(l, charges, **more).collect()]


@pytest.fixture(scope="module")
def dinner(spark):
    """A dinner on a card, and those who pay it back to an account, by days; rows 5 to 8 are no inflows that could."""
    rows = [(1, 2, day(10), -30_000), (2, 1, day(11), 6000), (3, 1, day(12), 6000), (4, 1, day(15), 6000), (5, 2, day(10), 500), (6, 1, day(10), -500), (7, 1, day(10), 700), (8, 1, day(10), 800), (9, 1, day(9), 6000)]
    l = tiny(spark, rows, links=[(7, None)], hidden=[8], kinds={2: "card"})  # noqa: E741
    return dataclasses.replace(l, txn=l.txn.withColumn("counterparty_norm", F.concat(F.lit("PAYNOW "), F.chr(F.col("txn_id") + 63))))


def test_paybacks_come_from_any_account_for_any_charge(dinner):
    near = [(1, 9), (1, 2), (1, 3), (1, 4)]  # of two as near the later id
    assert offered(dinner, 1) == near and offered(dinner, 1, days=2) == near[:3] and offered(dinner, 1, limit=1) == near[:1]
    assert offered(dinner, 1, text="paynow c") == [(1, 4)] and offered(dinner, 9999) == [] and offered(dinner, 1, days=0) == []
    taken = dataclasses.replace(dinner, payback=dinner.txn.sparkSession.createDataFrame([(1, 2), (1, 9)], "expense_txn_id long, income_txn_id long"))
    assert offered(taken, 1) == [(1, 3), (1, 4)]
    with pytest.raises(ValueError):
        offered(dinner, 1, limit=None)


def test_paybacks_without_a_bound_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, 1, day(rng.choice((0, 3, 40, 41, 200, 900)) + rng.randrange(3)), rng.choice((-5, 5))) for i in range(1, 120)] + [(500, 1, day(-4000), -5), (501, 1, day(5000), -5)]
    l = tiny(spark, rows)  # noqa: E741
    charges = [r for r in rows if r[3] < 0]
    want = []
    for c in sorted(charges):
        best = sorted((abs((r[2] - c[2]).days), -r[0]) for r in rows if r[3] > 0)[:7]
        want += [(c[0], -i) for _, i in best]
    assert offered(l, [c[0] for c in charges], limit=7) == want
    assert offered(tiny(spark, [(1, 1, day(0), -5)]), 1) == []


def queue(spark, rows, rules=()):
    made = spark.createDataFrame([(p, c, 0, categories.literal_of(p)) for p, c in rules], "pattern string, category string, weight int, literal string")
    return [(r["name"], r["n_rows"], r["value_minor"]) for r in categories.review_queue(spark.createDataFrame(rows, "name string, amount_minor long"), made).collect()]


def test_review_queue(spark):
    assert queue(spark, [("OFTEN", -200)] * 20 + [("COSTLY", -90_000)] * 2) == [("COSTLY", 2, 180_000), ("OFTEN", 20, 4000)]
    assert queue(spark, [("SHENG SIONG", -2000)] * 3 + [("MYSTERY", -5000)] * 2, [("sheng siong", "Grocery")]) == [("MYSTERY", 2, 10_000)]
    assert queue(spark, [("PAYLAH TOP UP", -1)] * 3 + [("FAST PAYMENT FROM: A N OTHER", -1), ("ATM", -1), ("PAYNOW TO MR TAN", -1), ("atm 3", -9), ("", -1), (None, -1)]) == []
    assert queue(spark, [(" SHOP ", -1500), ("SHOP", -1500), ("\tSHOP", -1)]) == [("SHOP", 3, 3001)]
    verdicts = spark.createDataFrame([("A", "Dining", True)], "name string, category string, needs_review boolean")
    none = spark.createDataFrame([], "pattern string, category string, weight int, literal string")
    told = categories.review_queue(spark.createDataFrame([("A", -2), ("B", -1)], "name string, amount_minor long"), none, verdicts=verdicts).collect()
    assert [(r["name"], r["model_verdict"], r["disputed"]) for r in told] == [("A", "Dining", True), ("B", None, False)]


def test_gaps_are_what_no_rule_matches(spark):
    rules = spark.createDataFrame([("X", "Dining", 0, None), ("Y", "Travel", 0, None)], "pattern string, category string, weight int, literal string")
    rows = spark.createDataFrame([("XY", -1)] * 5 + [("X", -1), ("Z", -1), ("", -1), (None, -1)], "name string, amount_minor long")
    assert [(r["name"], r["n_rows"]) for r in categories.gaps(rows, rules).collect()] == [("", 2), ("Z", 1)]
    assert tuple(categories.coverage(rows, rules).first()) == (1, 5, 3, 9, round(1 / 9, 4))
    assert tuple(categories.coverage(rows.limit(0), rules).first()) == (0, 0, 0, 0, 0.0)


def test_a_closing_before_the_window_is_not_known_in_it(spark):
    old, new = __import__("datetime").date(2023, 12, 31), __import__("datetime").date(2024, 2, 29)
    b = spark.createDataFrame([(1, 1, old, old, 0, 1000), (2, 2, new, new, 0, 50), (3, 3, new, new, 0, None)], "document_id long, account_id long, period_start date, period_end date, opening_minor long, closing_minor long")
    assert [tuple(r) for r in statements.growth(b, "2024-01-01").collect()] == [(new, 50, 1)]
    assert sorted(tuple(r)[1:] for r in statements.growth(b, every="statement").collect()) == [(1000, 1), (1050, 2)]
    with pytest.raises(ValueError):
        statements.growth(b, every="week")


@pytest.mark.parametrize("end, inside", [(118.5, True), (117.9, False), (118.0, False)])
def test_what_ends_two_points_before_the_table_is_none_of_it(spark, end, inside):
    columns = F.array(F.struct(F.lit("date").alias("name"), F.lit("date").alias("role"), F.lit(0).alias("sign"), F.lit(120.0).alias("left"), F.lit(140.0).alias("right")))
    word = F.struct(F.lit(100.0).alias("x0"), F.lit(end).alias("x1"), F.lit("w").alias("text"))
    assert (spark.range(1).select(layout.column_of(word, columns).alias("c")).first()["c"] == "date") == inside


@pytest.mark.parametrize(
    "pattern, literal",
    [
        (r"\bWIDGET\b", "widget"), (r"a.*(bcd)+e", "bcd"), (r"foo|bar", None), (r"x(?:abc)?yz", "yz"), (r"^\d+$", None), (r"A\.B\ C", "a.b c"), (r"(?=abc)de", "de"), (r"[abc]def[gh]", "def"),
        (r"(ab(cd|e)fgh)", "fgh"), (r"(", None), (r"\Qabc\E", None), (r"x{0,3}longer", "longer"), (r"naïve", "na"), ("", None),
    ],
)
def test_required_literal(pattern, literal):
    assert categories.required_literal(pattern) == literal


@settings(max_examples=200, deadline=None)
@given(st.text("ab.*+?(|)[c]^$\\d", max_size=12), st.text("abcdABD1. ", max_size=12))
def test_what_matches_holds_the_literal(pattern, name):
    try:
        found = re.compile(pattern, re.I).search(name)
    except re.error:
        return
    literal = categories.required_literal(pattern)
    assert not found or literal is None or literal in name.lower()


def test_index_equals_the_nested_loop(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdef", k=rng.randrange(2, 7))) for _ in range(60)]
    names = spark.createDataFrame([(" ".join(rng.choices(words, k=3)).upper(),) for _ in range(400)] + [("AB",), ("",)], "name string").distinct()
    shapes = [r"\b{}\b", "{}", "{}.*{}", "^{} ", "(?:{}|{})", "[{}]x?{}", "{}$"]
    rows = []
    for i in range(300):
        p = rng.choice(shapes)
        p = p.format(*(rng.choice(words) for _ in range(p.count("{}"))))
        rows.append((p, rng.choice("XYZ"), i % 3, categories.literal_of(p)))
    rules = spark.createDataFrame(rows, "pattern string, category string, weight int, literal string")
    got, want = ({tuple(r) for r in categories.matches(names, rules, few=few).collect()} for few in (0, 1000))
    assert got == want and len(got) > 500


def test_evidence_by_keys_equals_all_pairs(spark):
    rng = random.Random(11)
    numbers = {a: [f"XXXX-XXXX-XXXX-{1000 + a}"] if a % 2 else [] for a in range(1, 7)}
    rows = []
    for i in range(1, 400):
        a = rng.randrange(1, 7)
        text = rng.choice(["", "", f"to 0000-000-{rng.randrange(1, 7):03d}", f"card 4444-4444-4444-{1000 + rng.randrange(1, 7)}", f"{rng.randrange(1, 7):010d} and {rng.randrange(1, 7):010d}", "no 123"])
        rows.append((i, a, day(rng.randrange(90)), rng.choice((-1, 1)) * rng.choice((100, 200)), (text, "card" if a % 3 == 0 else "deposit", numbers[a])))
    reach = transfers.Reach(min_days=1, max_days=3, named_days=30, card_days=21)
    digits = lambda t: re.sub(r"\D", "", t)
    want = {}
    for o in rows:
        for i in rows:
            days = abs((o[2] - i[2]).days)
            if o[3] < 0 < i[3] and o[3] == -i[3] and o[1] != i[1] and days >= 1:
                names = lambda x, y: f"{y[1]:010d}" in [digits(r) for r in re.findall(r"[\d-]{6,}", x[4][0])]
                tails = lambda x, y: any(n[-4:] == t[-4:] for n in y[4][2] for t in re.findall(r"(?:\d{4}-){3}\d{4}|(?<!\d)\d{12,19}(?!\d)", x[4][0]))
                passes = [(names(o, i) or names(i, o)) and days <= 30, (tails(o, i) or tails(i, o)) and days <= 30, o[4][1] == "deposit" and i[4][1] == "card" and days <= 21, days <= 3]
                if any(passes):
                    want[o[0], i[0]] = (days, passes)
    got = {(r["out_txn_id"], r["in_txn_id"]): (r["days_apart"], r["passes"]) for r in transfers.candidates(legs(spark, rows), reach).collect()}
    assert got == want and all(any(p[r] for _, p in want.values()) for r in range(4))


def test_rules_and_categories_are_added_and_deleted(spark):
    schema = "rule_id long, pattern string, category_id long, weight int, literal string, note string"
    rules = spark.createDataFrame([(1, "KIOSK", 1, 0, None, "seed")], schema)
    names = spark.createDataFrame([(1, "Eating"), (2, "Moving")], "category_id long, name string")
    more = categories.added_rules(rules, spark.createDataFrame([("^A\\ B$", 2, 5, "mine")], "pattern string, category_id long, weight int, note string"))
    assert [tuple(r) for r in more.orderBy("rule_id").collect()][1] == (2, "^A\\ B$", 2, 5, "A B", "mine")
    assert categories.deleted_rules(more, spark.createDataFrame([(1,)], "rule_id long")).count() == 1
    with pytest.raises(ValueError):
        categories.added_rules(rules, spark.createDataFrame([("(", 2, 5, "mine")], "pattern string, category_id long, weight int, note string"))
    targets = spark.createDataFrame([(1, "KIOSK"), (2, "A B"), (3, "OTHER")], "txn_id long, name string")
    stored = spark.createDataFrame([(3, "Moving", "human"), (2, "Eating", "rule")], "txn_id long, category string, source string")
    after, filed = categories.decided_and_applied(rules, spark.createDataFrame([("A B", 2)], "name string, category_id long"), names, targets, stored)
    assert {tuple(r) for r in filed.collect()} == {(3, "Moving", "human"), (1, "Eating", "rule"), (2, "Moving", "rule")}
    assert {r["o"] for r in after.select(categories.rule_origin(F.col("weight"), F.col("note")).alias("o")).collect()} == {"operator", "imported"}
    back, filed = categories.undecided_and_applied(after, spark.createDataFrame([("a b",)], "name string"), names, targets, stored)
    assert back.count() == 1 and {tuple(r) for r in filed.collect()} == {(3, "Moving", "human"), (1, "Eating", "rule")}
    assert categories.added_category(names, "  Pets  and  more ").where("name = 'Pets and more' AND category_id = 3").count() == 1
    for bad in ("eating", " "):
        with pytest.raises(ValueError):
            categories.added_category(names, bad)
    free = names.unionByName(spark.createDataFrame([(9, "Unused")], "category_id long, name string"))
    assert categories.deleted_category(free, "Unused", rules, stored).count() == 2
    for used in ("Eating", "Moving"):
        with pytest.raises(ValueError):
            categories.deleted_category(free, used, rules, stored)
    with pytest.raises(LookupError):
        categories.deleted_category(free, "None", rules, stored)


def test_declared_series_have_what_found_ones_have(spark):
    rows = [(1, day(0), -500, "ACME"), (2, day(31), -520, "ACME"), (3, day(61), -530, "ACME"), (4, day(40), -900, "ACME"), (5, day(9), -500, "OTHER"), (6, day(2), -70, "SOLO")]
    seen = spark.createDataFrame([(*r, "") for r in rows], "txn_id long, posted_date date, amount_minor long, merchant string, description string")
    marks = spark.createDataFrame([("ACME", 500, "monthly"), ("SOLO", 70, "yearly"), ("GONE", 5, "weekly")], "merchant string, centre_minor long, period_label string")
    got = {r["merchant"]: r for r in recurrence.declared_series(seen, marks).collect()}
    acme, solo = got["ACME"], got["SOLO"]
    assert set(got) == {"ACME", "SOLO"} and (acme["centre_minor"], acme["tolerance_minor"], acme["period_days"], acme["txn_ids"], acme["total_minor"]) == (517, 36, 30, [1, 2, 3], 1550)
    assert acme["confidence"] == round(1 - (0.5 / 30.5) / 0.15, 4) and acme["expected_next"] == day(91)
    assert (solo["confidence"], solo["n_rows"], solo["expected_next"]) == (0.0, 1, day(367))
