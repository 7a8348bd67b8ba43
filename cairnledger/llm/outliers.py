"""Quality rules with robust multivariate outliers: base statistics, then minimum-covariance-determinant estimates.

Everything on the main path is a DataFrame or SQL function. The statistics of a text come from its word array alone,
so no text is shuffled. The estimates start from medians and median absolute deviations for each language and source, and
concentration steps then repeat: keep the share of rows nearest by Mahalanobis distance, re-estimate mean and covariance from
them. Each step is two aggregates with map-side partials over narrow rows; distances use the inverse Cholesky
factor, computed as columns of the small table of groups. A group's centre and covariance are drawn toward those of all rows by
the weight of PRIOR_ROWS rows, alike at every size: a great group keeps its own, a group of few rows has nearly those of all.

Defined results: a null or empty text has no words, fails the base rule and is no part of the estimates; a null
language or source is a value of its own; equal rows get equal verdicts; texts of any length count whole; an empty table
gives none; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, cut_lineage, small, words_of

#: Base rule: the least number of words, and the percentage of words in repeated windows beyond which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a group's rows that a concentration step keeps, the steps, and the rows that the estimate over all rows counts for in
#: that of each group.
KEPT_SHARE, STEPS, PRIOR_ROWS = 0.75, 5, 50
#: Standard deviation that is added to each feature's own (as a variance): differences far below it are of no importance to quality.
FLOORS = {"symbols": 0.05, "lines": 0.05, "repeats": 0.06, "word_length": 0.08}
#: Median of the chi-square distribution with four degrees of freedom, and the distance that it exceeds in five of a million cases.
CHI_MEDIAN, CUTOFF = 3.3567, 30.0
FEATURES = list(FLOORS)
P = len(FEATURES)
#: Low bits of a packed window that hold its position.
AT = 31


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    A 3-word window is packed as hash bits above its position, so sorting plain longs brings equal windows together;
    the few windows whose hash bits agree with a neighbour are then compared by their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = lambda i: F.get("__w", i)
    first = docs.select("*", words_of(F.col(text_col)).alias("__w"), lines.alias("__l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    packed = F.transform(
        F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))),
        lambda w, i: F.shiftleft(F.xxhash64(w, at(i + 1), at(i + 2)), AT).bitwiseOR(i.cast("long")),
    )
    ordered = first.withColumn("__s", F.sort_array(packed)).select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
    ).drop("__l")
    same = lambda x, i: F.coalesce(F.shiftright(F.get("__s", i), AT) == F.shiftright(x, AT), F.lit(False))
    mask = F.lit((1 << AT) - 1)
    alike = F.filter(
        F.transform("__s", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x.bitwiseAND(mask)).otherwise(-1)), lambda p: p >= 0
    )
    windows = F.transform(alike, lambda p: F.struct(at(p.cast("int")).alias("a"), at(p.cast("int") + 1).alias("b"), at(p.cast("int") + 2).alias("c"), p.alias("p")))
    compared = ordered.withColumn("__e", F.sort_array(windows)).drop("__s", "__w")
    key = lambda x: F.struct(x["a"], x["b"], x["c"])
    twin = lambda x, i: F.coalesce(key(F.get("__e", i)) == key(x), F.lit(False))
    found = F.filter(F.transform("__e", lambda x, i: F.when(twin(x, i - 1) | twin(x, i + 1), x["p"]).otherwise(-1)), lambda p: p >= 0)
    covered = F.array_distinct(F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2))))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = compared.withColumn("n_repeat_words", F.size(covered).cast("long"))
    # A generator of one row: the optimizer moves no filter on the statistics below it, where it would compute them anew
    # for every word.
    held = counted.select(*docs.columns, F.explode(F.array(F.struct(*made))).alias("__stats"))
    return held.select(*docs.columns, *(F.col(f"__stats.{c}").alias(c) for c in made))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistic vector of a row that has words: square roots of rates, and the log of the mean word length."""
    per_word = lambda c: F.sqrt(F.col(c) / F.col("n_words"))
    values = {
        "symbols": F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        "lines": per_word("n_dup_lines"),
        "repeats": F.col("n_repeat_words") / F.col("n_words"),
        "word_length": F.log(F.col("word_chars") / F.col("n_words")),
    }
    return [values[f].alias(f) for f in FEATURES]


def inverse_factor(groups: DataFrame) -> DataFrame:
    """groups with covariance columns s_ij (i >= j) to the same with k_ij, the inverse of the Cholesky factor, and log_det."""
    s = lambda i, j: F.col(f"s_{i}{j}")
    l = lambda i, j: F.col(f"l_{i}{j}")  # noqa: E731, E741
    k = lambda i, j: F.col(f"k_{i}{j}")
    for j in range(P):
        rest = sum((l(j, m) * l(j, m) for m in range(j)), F.lit(0.0))
        groups = groups.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(s(j, j) - rest, F.lit(1e-12))))
        groups = groups.withColumns({f"l_{i}{j}": (s(i, j) - sum((l(i, m) * l(j, m) for m in range(j)), F.lit(0.0))) / l(j, j) for i in range(j + 1, P)})
    for j in range(P):
        groups = groups.withColumn(f"k_{j}{j}", 1 / l(j, j))
        for i in range(j + 1, P):
            groups = groups.withColumn(f"k_{i}{j}", -sum((l(i, m) * k(m, j) for m in range(j, i)), F.lit(0.0)) / l(i, i))
    log_det = 2 * sum((F.log(l(j, j)) for j in range(P)), F.lit(0.0))
    return groups.withColumn("log_det", log_det).drop(*(f"{c}_{i}{j}" for c in "sl" for i in range(P) for j in range(i + 1)))


def distance() -> Column:
    """Squared Mahalanobis distance of a row that carries its group's m_i and k_ij."""
    d = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    parts = [sum((F.col(f"k_{i}{j}") * d[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((p * p for p in parts), F.lit(0.0))


def by_group(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """rows joined to their group's columns; nulls are values."""
    g = small(groups.withColumnsRenamed({"g_lang": "h_lang", "g_source": "h_source", "g_all": "h_all"}), n)
    on = (F.col("g_all") == F.col("h_all")) & F.col("g_lang").eqNullSafe(F.col("h_lang")) & F.col("g_source").eqNullSafe(F.col("h_source"))
    return rows.join(g, on).drop("h_lang", "h_source", "h_all")


def drawn_together(raw: DataFrame) -> DataFrame:
    """The groups' n, m_i and s_ij, each with its share of those of all rows, to keys, m_i and k_ij."""
    made = [*(f"m_{i}" for i in range(P)), *(f"s_{i}{j}" for i in range(P) for j in range(i + 1))]
    pooled = raw.where("g_all").select(F.lit(1).alias("one"), *(F.col(c).alias(f"all_{c}") for c in made))
    own = raw.where("NOT g_all").withColumn("one", F.lit(1)).join(F.broadcast(pooled), "one")
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    mixed = own.select("g_all", "g_lang", "g_source", *((share * F.col(c) + (1 - share) * F.col(f"all_{c}")).alias(c) for c in made))
    return inverse_factor(mixed)


def estimates(rows: DataFrame) -> DataFrame:
    """Per group (g_all, g_lang, g_source) of rows with features, but for that of all rows, which g_all marks: m_i, k_ij and `scale`,
    which brings the median distance to its expectation."""
    keys = ["g_all", "g_lang", "g_source"]
    floor = [F.lit(v * v) for v in FLOORS.values()]
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(2000))
    centre = cut_lineage(rows.groupBy(*keys).agg(*(median(f).alias(f"m_{i}") for i, f in enumerate(FEATURES))))
    n = centre.count()
    spread = by_group(rows, centre, n).groupBy(*keys, *(f"m_{i}" for i in range(P))).agg(
        *(median(F.abs(F.col(f) - F.col(f"m_{i}"))).alias(f"d_{i}") for i, f in enumerate(FEATURES))
    )
    state = spread.select(
        *keys, *(f"m_{i}" for i in range(P)),
        *((F.pow(F.col(f"d_{i}") * 1.4826, 2) + floor[i] if i == j else F.lit(0.0)).alias(f"s_{i}{j}") for i in range(P) for j in range(i + 1)),
    )
    state = cut_lineage(inverse_factor(state))
    for step in range(STEPS):
        near = by_group(rows, state, n).withColumn("d", distance())
        limit = cut_lineage(near.groupBy(*keys).agg(F.percentile_approx("d", F.lit(KEPT_SHARE), F.lit(2000)).alias("limit")))
        kept = by_group(near.drop(*(c for c in state.columns if c not in keys)), limit, n).where("d <= limit")
        sums = kept.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *(F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)),
            *(F.covar_pop(a, b).alias(f"c_{i}{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES[: i + 1])),
        )
        raw = cut_lineage(sums.select(
            *keys, "n", *(f"m_{i}" for i in range(P)),
            *((F.col(f"c_{i}{j}") + (floor[i] if i == j else 0.0)).alias(f"s_{i}{j}") for i in range(P) for j in range(i + 1)),
        ))
        state = cut_lineage(inverse_factor(raw.drop("n")) if step < STEPS - 1 else drawn_together(raw))
    middle = by_group(rows, state, n).withColumn("d", distance()).groupBy(*keys).agg(median("d").alias("middle"))
    scale = F.greatest(F.col("middle") / CHI_MEDIAN, F.lit(1.0)).alias("scale")
    return cut_lineage(by_group(state, middle, n).select(*state.columns, scale))


def judges(passed: DataFrame) -> DataFrame:
    """(lang, source) to the estimate that judges its rows: m_i, k_ij, scale."""
    keys = ["g_all", "g_lang", "g_source"]
    own = passed.select(F.lit(False).alias("g_all"), F.col("lang").cast("string").alias("g_lang"), F.col("source").cast("string").alias("g_source"), *FEATURES)
    every = passed.select(F.lit(True).alias("g_all"), *(F.lit(None).cast("string").alias(k) for k in keys[1:]), *FEATURES)
    return estimates(own.unionByName(every)).withColumnsRenamed({"g_lang": "lang", "g_source": "source"}).drop("g_all")


def same_group(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """rows joined to columns of their language and source; nulls are values."""
    g = small(groups.withColumnsRenamed({"lang": "h_lang", "source": "h_source"}), n)
    return rows.join(g, F.col("lang").eqNullSafe(F.col("h_lang")) & F.col("source").eqNullSafe(F.col("h_source"))).drop("h_lang", "h_source")


def with_verdict(passed: DataFrame, fits: DataFrame) -> DataFrame:
    judged = same_group(passed, fits, fits.count()).withColumn("distance", distance() / F.col("scale"))
    return judged.drop(*FEATURES, *fits.drop("lang", "source").columns).withColumn("kept", F.col("distance") <= CUTOFF)


def judge(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the statistics, base_failed, distance and kept."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = as_table(text_statistics(named).drop("text").withColumn("base_failed", base_failed()))
    passed = stats.where(~F.col("base_failed")).select("*", *features())
    failed = stats.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", "lang", "source"]
    return with_verdict(passed, judges(passed)).select(*columns).unionByName(failed.select(*columns))


def kept_documents(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns. Rows that pass the base rule are written once with their statistics, from
    which the estimates read the narrow columns and the verdicts the rows."""
    columns = docs.columns
    named = docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)),
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"),
    )
    kept = [*(f"c{i}" for i in range(len(columns))), "lang", "source"]
    passed = as_table(text_statistics(named).where(~base_failed()).select(*kept, *features()))
    return with_verdict(passed, judges(passed.select("lang", "source", *FEATURES))).where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
