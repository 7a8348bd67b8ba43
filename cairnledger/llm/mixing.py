"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. A source that is to give a part of its words gives the documents whose hash lies below a
threshold. Words are summed by source and hash bucket; the bucket in which the budget runs out is refined into
buckets of its own, level by level, until it holds one hash value; then a filter on the hash takes the documents.
Nothing is sorted. A source whose target exceeds its size is taken whole as often as it fits, and the rest by
threshold, so the documents of a lower budget are always among those of a higher one.

Defined results: a null text has size 0; a null source is a source of its own and comes last; documents of size 0 are
taken as often as their hash says and add nothing; rows that agree in id, source and text share a hash and are taken
together; with no documents or no words, all targets are 0; texts of any length count whole; other columns of the input are not touched.
The hash depends on the row alone, so reruns agree.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, cut_lineage, n_words_of, numbered, small

#: Bits of the hash that one level of a histogram adds, and the levels that use up the hash.
BITS, LEVELS = 10, 6


def row_hash(id_col: str, source_col: str, text_col: str) -> Column:
    """The first 60 bits of a digest of the row's values, as the upper bits of a long; a digest that any SQL engine has."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    digest = F.md5(F.concat_ws("\u001f", told(id_col), told(source_col), told(text_col)))
    return F.shiftleft(F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long"), 64 - BITS * LEVELS)


def prefix(level: int) -> Column:
    """The first bits of the hash, as many as `level` levels have."""
    return F.shiftrightunsigned("hash", 64 - BITS * level)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights by rank share the sum of all sizes, and no target
    exceeds `most` times its source's size. The shares rise together like water; one aggregate row a round is read."""
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    caps = cut_lineage(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    level, full = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        r = caps.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("given"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("full"),
        ).first()
        if r["free"] is None or r["full"] == full:
            break
        level, full = (r["all"] - r["given"]) / r["free"], r["full"]
    return caps.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `whole` (times that all documents are taken), and `levels` and `cut`: the documents whose hash prefix of so
    many levels is below the cut are taken once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("whole", whole).select(
        "*",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
        F.lit(0).alias("levels"),
        F.lit(0).cast("long").alias("cut"),
        F.lit(True).alias("open"),
    )
    state = cut_lineage(state)
    n = state.count()
    for level in range(1, LEVELS + 1):
        rows = sized.join(small(state.where("open").select(F.col("source").alias("s"), "cut"), n), F.col("source").eqNullSafe(F.col("s")))
        inside = rows if level == 1 else rows.where(prefix(level - 1) == F.col("cut"))
        buckets = inside.groupBy("s", prefix(level).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # The running sum over a source's 1,024 buckets at most, as an array: where does the budget run out?
        per_source = buckets.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("bucket", "words", (F.col("low") == F.col("high")).alias("single")))).alias("b"))
        joined = state.join(small(per_source, n), F.col("source").eqNullSafe(F.col("s")), "left")
        spent = F.aggregate(
            "b",
            F.struct(F.lit(0).cast("double").alias("before"), F.lit(None).cast("long").alias("bucket"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("single")),
            lambda a, x: F.when(a["bucket"].isNotNull(), a)
            .when(a["before"] + x["words"] > F.col("budget"), F.struct(a["before"].alias("before"), x["bucket"].alias("bucket"), x["words"].alias("words"), x["single"].alias("single")))
            .otherwise(F.struct((a["before"] + x["words"]).alias("before"), a["bucket"].alias("bucket"), a["words"].alias("words"), a["single"].alias("single"))),
        )
        state = joined.withColumn("r", F.when(F.col("open") & F.col("b").isNotNull(), spent))
        ends = F.col("r.single") | F.lit(level == LEVELS)
        left = F.col("budget") - F.col("r.before")
        # At the end the bucket that is left, of one hash value, is taken if that comes nearer to the budget.
        edge = F.col("r.bucket") + F.when(ends & (left * 2 >= F.col("r.words")), 1).otherwise(0)
        past = F.lit(1 << BITS).cast("long")
        found = F.col("r.bucket").isNotNull()
        # A first level that the budget covers whole is cut past its last bucket; deeper, the budget always runs out inside.
        cut = F.when(found, edge).when(F.col("r").isNotNull(), past if level == 1 else F.shiftleft(F.col("cut") + 1, BITS)).otherwise(F.col("cut"))
        state = cut_lineage(
            state.select(
                "source", "source_size", "target", "whole",
                F.when(found, left).otherwise(F.col("budget")).alias("budget"),
                F.when(F.col("r").isNotNull(), F.lit(level)).otherwise(F.col("levels")).alias("levels"),
                cut.alias("cut"),
                (F.col("open") & found & ~ends).alias("open"),
            )
        )
        if not state.where("open").limit(1).count():
            break
    return state.drop("budget", "open")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): a narrow row (doc_id, source, size, hash) for each document, and the plan of each source."""
    sized = as_table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words_of(F.col(text_col)).alias("size"),
            row_hash(id_col, source_col, text_col).alias("hash"),
        )
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, source_targets(cut_lineage(sizes), weights, most))


def times() -> Column:
    """How often a document is taken, from its hash and its source's plan."""
    below = F.lit(False)
    for level in range(1, LEVELS + 1):
        below = below | ((F.col("levels") == level) & (prefix(level) < F.col("cut")))
    return F.col("whole") + F.when(below, 1).otherwise(0)


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows, which have source and hash, with the plan of their source and `times`."""
    plan = plan.withColumnRenamed("source", "__source")
    joined = rows.join(small(plan, plan.count()), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.withColumn("times", times())


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized, plan = mix(docs, **options)
    rows = with_plan(sized, plan)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken. The texts stay where they were read."""
    _, plan = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*columns, F.col(source_col).alias("source"), row_hash(id_col, source_col, text_col).alias("hash"))
    copies = with_plan(rows, plan).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
