"""Categorisation by rules, over distinct names.

Rules that are anchored literals meet names by a hash join, and many patterns by an index of the texts that they require; only the others are
tried on every distinct name.
"""

from __future__ import annotations

import re
from re import _parser as regex_parts

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import money, text
from .grouped import settled

OTHERS = "Others"
#: The categories that a ledger starts with.
CATEGORIES = (
    "Grocery", "Dining", "Transport", "Bills and utilities", "Insurance", "Healthcare", "Wellness", "Recreation", "Travel", "Furnishing",
    "Electronics", "Fashion", "Business services", "Fees and charges", "Others",
)
#: Rules beyond which they are no longer sent to every executor.
MOST_RULES = 20_000
#: Patterns up to which each is tried on every name, and the characters by which more of them meet names.
FEW_PATTERNS, GRAM = 200, 3
#: Minor units of a slice in which magnitudes are counted on the way to a median, and the slice of those that are none.
SLICE, LOWEST = 65_536, -(2**63)
#: Weight and note of a person's decision.
OPERATOR_WEIGHT, OPERATOR_NOTE = 100, "decided by operator"


def literal_of(pattern: str) -> str | None:
    """The text that an anchored, escaped literal pattern stands for; None for any other pattern."""
    if not (pattern.startswith("^") and pattern.endswith("$")):
        return None
    plain = re.sub(r"\\(.)", r"\1", pattern[1:-1])
    return plain if re.escape(plain) == pattern[1:-1] else None


def operator_rule(name: str, category: str) -> tuple[str, str, int, str]:
    """The rule (pattern, category, weight, note) that settles one name."""
    return f"^{re.escape(name)}$", category, OPERATOR_WEIGHT, OPERATOR_NOTE


def required_literal(pattern: str) -> str | None:
    """The longest text that whatever the pattern matches must hold, in lower case; None if it has none or can't be read.

    Runs of plain ASCII characters count, also inside groups and repetitions that occur at least once; branches, classes and looks ahead break them.
    """
    best, run = "", ""

    def walk(parts) -> None:
        nonlocal best, run
        for kind, value in parts:
            name = str(kind)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            if name == "AT":  # no text is between what stands before and after it
                continue
            best, run = max(best, run, key=len), ""
            if name == "SUBPATTERN":
                walk(value[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                walk(value[2])
            best, run = max(best, run, key=len), ""

    try:
        walk(regex_parts.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return max(best, run, key=len) or None


@F.pandas_udf(StringType())
def required_literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literal)


def grams(text_: Column) -> Column:
    """The distinct runs of GRAM characters of a text."""
    starts = F.when(F.length(text_) >= GRAM, F.sequence(F.lit(1), F.length(text_) - GRAM + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text_, i, F.lit(GRAM))))


def matches_by_index(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, category, weight, pattern) of the patterns that match, each tried on the names that hold its required literal only.

    Names meet rules by one run of GRAM characters: of those that a rule's literal has, the one that the fewest names hold. A rule with a run that no name
    holds matches none.
    """
    held = names.select("name", F.explode(grams(F.lower("name"))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    cut = rules.select("pattern", "category", "weight", "needs").distinct().withColumn("n_grams", F.size(grams(F.col("needs"))))
    each = cut.withColumn("gram", F.explode(grams(F.col("needs")))).join(counts, "gram")
    keyed = each.groupBy("pattern", "category", "weight", "needs", "n_grams").agg(F.count(F.lit(1)).alias("present"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("present = n_grams")
    met = held.join(keyed, "gram").where(F.contains(F.lower("name"), F.col("needs")) & F.regexp_like("name", F.concat(F.lit("(?i)"), F.col("pattern"))))
    return met.select("name", "category", "weight", "pattern")


def matches(names: DataFrame, rules: DataFrame, few: int = FEW_PATTERNS) -> DataFrame:
    """(name, category, weight, pattern) of all rules that match distinct names. rules: pattern, category, weight, literal?.

    Anchored literals are a hash join. Of other patterns up to `few` are tried on every name; where there are more, those with a required literal meet only
    the names that hold it.
    """
    exact = rules.where("literal IS NOT NULL").select(F.upper("literal").alias("key"), "category", "weight", "pattern")
    by_literal = names.withColumn("key", F.upper("name")).join(exact, "key").drop("key")
    general = rules.where("literal IS NULL").select("pattern", "category", "weight")
    columns = ["name", "category", "weight", "pattern"]
    found = by_literal.select(*columns)
    if general.count() > few:
        needed = settled(general.withColumn("needs", required_literals("pattern")))
        indexed = F.length("needs") >= GRAM
        found = found.unionByName(matches_by_index(names, needed.where(indexed)))
        general = needed.where(~F.coalesce(indexed, F.lit(False)))
    # Patterns without a literal are tried on every name; names are dealt to tasks where there are too many patterns to send.
    hint = F.broadcast if general.count() <= MOST_RULES else lambda df: df
    by_pattern = names.join(hint(general), F.regexp_like("name", F.concat(F.lit("(?i)"), F.col("pattern"))))
    return found.unionByName(by_pattern.select(*columns))


def categorise(names: DataFrame, rules: DataFrame) -> DataFrame:
    """name, category, decided, contested. The heaviest, then the longest pattern decides; a tie between categories
    leaves the name in Others."""
    rank = F.rank().over(Window.partitionBy("name").orderBy(F.col("weight").desc(), F.length("pattern").desc()))
    best = matches(names, rules).withColumn("rank", rank).where("rank = 1")
    winners = best.groupBy("name").agg(F.min("category").alias("low"), F.max("category").alias("high"))
    judged = names.join(winners, "name", "left")
    contested = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    decided = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    return judged.select("name", F.when(decided, F.col("low")).otherwise(OTHERS).alias("category"), decided.alias("decided"), contested.alias("contested"))


def folded(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and total magnitude of each distinct combination of keys, written once: what patterns are tried on is names and not rows, also where the
    planner would move a filter below the count. rows: the keys, amount_minor."""
    return settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.abs("amount_minor")).alias("value_minor")))


def tallied(counted: DataFrame) -> DataFrame:
    """The same of each distinct name that there is. counted: name, n_rows, value_minor."""
    return counted.where("name <> ''").groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.sum("value_minor").alias("value_minor"))


def review_queue(rows: DataFrame, rules: DataFrame, limit: int | None = 500, verdicts: DataFrame | None = None) -> DataFrame:
    """Names that no rule decides and a person could place, by value; contested ones are marked. Names are without white space around them;
    persons, accounts and conduits are nobody's to classify. With verdicts (name, category, needs_review) also what models said of
    each name, and whether they disagreed."""
    counted = settled(tallied(folded(rows, "name").withColumn("name", text.strip(F.col("name")))))
    asked = counted.where(~text.is_personal(F.col("name")) & ~text.is_conduit(F.col("name")))
    open_ = categorise(asked.select("name"), rules).where("NOT decided").select("name", "contested")
    queue = asked.join(open_, "name")
    if verdicts is not None:
        told = verdicts.select("name", F.col("category").alias("model_verdict"), F.col("needs_review").alias("disputed"))
        queue = queue.join(told, "name", "left").withColumn("disputed", F.coalesce("disputed", F.lit(False)))
    queue = queue.orderBy(F.col("value_minor").desc(), "name")
    return queue if limit is None else queue.limit(limit)


def coverage(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows decided, contested and unmatched, and the decided share; rows without a name are among the unmatched."""
    counted = rows.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    judged = counted.join(categorise(counted.select("name"), rules), "name")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_rows"))), F.lit(0))
    sums = judged.agg(
        some(F.col("decided")).alias("decided"), some(F.col("contested")).alias("contested"),
        some(~F.col("decided") & ~F.col("contested")).alias("unmatched"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    )
    return sums.withColumn("share", F.when(F.col("n_rows") == 0, 0.0).otherwise(F.bround(F.col("decided") / F.greatest("n_rows", F.lit(1)), 4)))


def gaps(rows: DataFrame, rules: DataFrame, top: int = 20) -> DataFrame:
    """The names of most rows that no rule matches; what rules contest is no gap."""
    counted = rows.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.abs("amount_minor")).alias("value_minor"))
    open_ = categorise(counted.select("name"), rules).where("NOT decided AND NOT contested").select("name")
    return counted.join(open_, "name").orderBy(F.col("n_rows").desc(), "name").limit(top)


def upper_median_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) with the larger of two middles. Values are counted in slices of SLICE, and only those of the slice that holds a key's middle one
    by one, so that a frequent key is neither an array in memory nor a sort of one task."""
    cut = rows.select(key, value, F.coalesce(F.floor(F.col(value) / SLICE), F.lit(LOWEST)).alias("slice")).where(F.col(key).isNotNull())
    upto = lambda c: F.sum("n").over(Window.partitionBy(key).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    counted = cut.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumns({"upto": upto("slice"), "middle": F.floor(F.sum("n").over(Window.partitionBy(key)) / 2)})
    held = placed.where("upto > middle AND upto - n <= middle").select(key, "slice", (F.col("middle") - F.col("upto") + F.col("n")).alias("at"))
    each = cut.join(held, [key, "slice"]).groupBy(key, "at", value).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("upto", upto(value)).where("upto > at AND upto - n <= at").select(key, F.col(value).alias("median"))


def propose(rows: DataFrame, rules: DataFrame, suggest: DataFrame, fold: bool = True, by: str = "value_minor") -> DataFrame:
    """Names worth asking about: no person, no conduit, no settled name; with rows, typical gate, value, and a hint; most first by value_minor or
    n_rows. Of sample lines that are as frequent the first by text is shown.

    rows: name, amount_minor, description.
    """
    lines = folded(rows, "name", "description")
    marked = lines.where("name <> ''").select("name", text.is_personal(F.col("description")).alias("p")).groupBy("name").agg(F.bool_or("p").alias("personal_line"))
    asked = settled(tallied(lines).join(marked.where("NOT personal_line").select("name"), "name").where(~text.is_personal(F.col("name")) & ~text.is_conduit(F.col("name"))))
    decided = categorise(asked.select("name"), rules).where("decided").select("name")
    hints = categorise(asked.select("name"), suggest).where("decided").select("name", F.col("category").alias("suggested"))
    typical = upper_median_by(rows.select("name", F.abs("amount_minor").alias("m")), "name", "m").select("name", money.gate(F.col("median")).alias("typical_minor"))
    sampled = lines.select("name", "n_rows", text.redact(F.col("description"), fold).alias("sample")).where("sample <> ''").groupBy("name", "sample").agg(F.sum("n_rows").alias("n"))
    sample = sampled.groupBy("name").agg(F.min_by("sample", F.struct(-F.col("n"), "sample")).alias("sample"))
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]+", "")
    told = F.coalesce(F.col("sample"), F.lit(""))
    shown = F.when(letters(told).startswith(letters(F.col("name"))), "").otherwise(told)
    kept = asked.join(decided, "name", "left_anti").join(hints, "name", "left").join(typical, "name").join(sample, "name", "left")
    return kept.select("name", "n_rows", "typical_minor", "value_minor", "suggested", shown.alias("sample")).orderBy(F.col(by).desc(), "name")


def consolidate(votes: DataFrame, valid: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(model, name, category) to one verdict a name: the category of most models, those who agreed and answered, dissent.
    Unknown categories don't vote, and a model that is silent doesn't dissent."""
    cast = votes.withColumn("name", F.trim("name")).where((F.col("name") != "") & F.col("category").isin(*valid))
    sides = cast.groupBy("name", "category").agg(F.count(F.lit(1)).alias("agreed"), F.array_join(F.sort_array(F.collect_list("model")), ",").alias("models"))
    ranked = sides.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.col("agreed").desc(), "category")))
    dissent = F.sort_array(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "category", "models"))))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    out = ranked.groupBy("name").agg(first("category").alias("category"), first("agreed").alias("agreed"), F.sum("agreed").alias("answered"), dissent.alias("d"))
    shown = F.array_join(F.transform("d", lambda x: F.concat_ws(":", x["category"], x["models"])), ";")
    return out.select("name", "category", "agreed", "answered", (F.col("agreed") != F.col("answered")).alias("needs_review"), shown.alias("dissent"))


def consensus_rules(verdicts: DataFrame) -> DataFrame:
    """Rules for the names that all models put in one category other than Others."""
    escaped = F.concat(F.lit("^"), F.regexp_replace("name", r"([^A-Za-z0-9_])", r"\\$1"), F.lit("$"))
    agreed = verdicts.where(f"NOT needs_review AND category <> '{OTHERS}'")
    return agreed.select(escaped.alias("pattern"), "category", F.lit(0).alias("weight"), F.col("name").alias("literal"))


def apply_rules(targets: DataFrame, stored: DataFrame, rules: DataFrame) -> DataFrame:
    """Enrichment after a run: rows that people set stay, all others are made anew. targets: txn_id, name; stored: txn_id, category, source."""
    human = stored.where("source = 'human'").select("txn_id", "category", "source")
    open_ = targets.join(human.select("txn_id"), "txn_id", "left_anti")
    names = open_.select("name").where("name <> ''").distinct()
    decided = categorise(names, rules).where("decided").select("name", "category")
    made = open_.join(decided, "name").select("txn_id", "category", F.lit("rule").alias("source"))
    return human.unionByName(made)


def named_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules (rule_id, pattern, category_id, weight, literal, note) with the present names of their categories (category_id, name), so that a
    renamed category keeps its rules; heaviest first, then by id."""
    names = categories.select("category_id", F.col("name").alias("category"))
    return rules.join(names, "category_id").select("rule_id", "pattern", "category", "weight", "literal", "note").orderBy(F.col("weight").desc(), "rule_id")


def without_decision(rules: DataFrame, names: DataFrame) -> DataFrame:
    """rules but those by which a person settled the given names."""
    own = names.select(F.upper("name").alias("key")).distinct().withColumn("note", F.lit(OPERATOR_NOTE))
    return rules.withColumn("key", F.upper("literal")).join(own, ["key", "note"], "left_anti").select(rules.columns)


def decide(rules: DataFrame, decided: DataFrame) -> DataFrame:
    """rules with those of a person's decisions (name, category_id) in place of earlier ones on the same names. Ids go on from the highest."""
    escaped = F.concat(F.lit("^"), F.regexp_replace("name", r"([^A-Za-z0-9_])", r"\\$1"), F.lit("$"))
    highest = rules.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("m")).first()["m"]
    order = Window.partitionBy(F.lit(1)).orderBy("name")  # a batch is what a person decided at once
    made = decided.select(
        (F.row_number().over(order) + highest).cast("long").alias("rule_id"), escaped.alias("pattern"), "category_id", F.lit(OPERATOR_WEIGHT).alias("weight"),
        F.col("name").alias("literal"), F.lit(OPERATOR_NOTE).alias("note"),
    )
    return without_decision(rules, decided).unionByName(made.select(rules.columns))


def seed(defaults: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The defaults that the store lacks: what seeding appends. Seeding twice appends nothing."""
    return defaults.join(stored.select(key), key, "left_anti").select(defaults.columns)


def rule_origin(weight: Column, note: Column) -> Column:
    """Who put a rule there: a person, by both weight and note of a decision, or an import."""
    return F.when((weight == OPERATOR_WEIGHT) & (note == OPERATOR_NOTE), "operator").otherwise("imported")


def added_rules(rules: DataFrame, more: DataFrame) -> DataFrame:
    """rules with more (pattern, category_id, weight, note), numbered on from the highest by pattern; a pattern that can't be read is refused."""
    patterns = [r["pattern"] for r in more.select("pattern").collect()]  # what a person adds at once
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"not a pattern: {p}") from e
    literal = F.pandas_udf(lambda s: s.map(literal_of), StringType())
    highest = rules.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("m")).first()["m"]
    order = Window.partitionBy(F.lit(1)).orderBy("pattern", "category_id")
    made = more.select((F.row_number().over(order) + highest).cast("long").alias("rule_id"), "pattern", "category_id", "weight", literal("pattern").alias("literal"), "note")
    return rules.unionByName(made.select(rules.columns))


def deleted_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """rules without those named (rule_id)."""
    return rules.join(gone.select("rule_id"), "rule_id", "left_anti").select(rules.columns)


def decided_and_applied(rules: DataFrame, decided: DataFrame, categories: DataFrame, targets: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, enrichment) after a person has settled names (name, category_id): the rules with these decisions, and what they make of all targets."""
    after = decide(rules, decided)
    return after, apply_rules(targets, stored, named_rules(after, categories))


def undecided_and_applied(rules: DataFrame, names: DataFrame, categories: DataFrame, targets: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, enrichment) after a person has taken decisions on names back; rules that came in otherwise stay."""
    after = without_decision(rules, names)
    return after, apply_rules(targets, stored, named_rules(after, categories))


def added_category(categories: DataFrame, name: str) -> DataFrame:
    """categories (category_id, name) with one more; a name that is there already, in whatever case, is refused."""
    cleaned = " ".join(name.split())
    if not cleaned:
        raise ValueError("a category needs a name")
    if not categories.where(F.lower("name") == cleaned.lower()).isEmpty():
        raise ValueError(f"there is a category {cleaned}")
    highest = categories.agg(F.coalesce(F.max("category_id"), F.lit(0)).alias("m")).first()["m"]
    return categories.unionByName(categories.sparkSession.createDataFrame([(highest + 1, cleaned)], "category_id long, name string"))


def deleted_category(categories: DataFrame, name: str, rules: DataFrame, enrichment: DataFrame) -> DataFrame:
    """categories without one that nothing uses; refused while a rule (category_id) or a transaction (category) does."""
    own = categories.where(F.col("name") == name)
    if own.isEmpty():
        raise LookupError(f"no category {name}")
    n_rules = rules.join(own.select("category_id"), "category_id", "left_semi").count()
    n_rows = enrichment.where(F.col("category") == name).count()
    if n_rules or n_rows:
        raise ValueError(f"{name} is in use: {n_rules} rules and {n_rows} transactions")
    return categories.where(F.col("name") != name)
