"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidate spans: three base kinds, and shapes of further credentials. The digest of
each candidate's value is aggregated over the corpus by distinct repositories (documents) and owners (sources). A value that
many owners or many repositories hold is an example that was copied; one that few of both hold and that looks random is taken for live.
Base spans are always reported; the method adds the further spans whose value is live.

Defined results: a null or empty text has no spans; offsets count code points, the end is exclusive; a null owner
is an owner of its own; rows with equal ids are scanned one by one, and are one repository; a very long text is scanned whole; equal
values count once for each repository and owner; an empty table gives none; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

#: The base kinds in the order in which ties are listed: a string that every match holds, the pattern, and
#: the group and length that count.
BASE = {
    "assign": (":=", re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    "access": ("K", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": ("0123456789abcdef", re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: Shapes of further credentials, each after a string that every match holds; group 1 is the value.
FURTHER = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]{32,}?)-----END [A-Z ]*PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    "prefixed": ("", re.compile(r"(?<![A-Za-z0-9])((?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29\.|npm_|pypi-)[A-Za-z0-9_-]{16,})")),
    "bearer": ("Bearer", re.compile(r"\bBearer\x20+([A-Za-z0-9+/_.=-]{20,})")),
    "url_login": ("://", re.compile(r"://[^\s:/@]+:([^\s:/@]{8,})@")),
    "quoted": ("", re.compile(r"[\"'](?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])([A-Za-z0-9+/_=-]{20,})[\"']")),
}
KINDS = [*BASE, *FURTHER]

#: A value held by this many owners, or by this many repositories of however few owners, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 4, 8
#: Bits a character that a live value has at least.
LIVE_ENTROPY = 2.8

FOUND = "n_assign long, n_access long, n_hex long, found array<struct<kind:int,start:int,end:int,digest:string,entropy:double>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds. A match whose counted group is too short is dropped after it was taken."""
    out = []
    for kind, (needs, pattern, group, least) in enumerate(BASE.values()):
        if any(c in text for c in needs):
            out += [(m.start(), kind, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def further_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the further shapes where no base span lies."""
    out = []
    for kind, (needs, pattern) in enumerate(FURTHER.values(), len(BASE)):
        if needs in text:
            out += [(m.start(1), kind, m.end(1), m[1]) for m in pattern.finditer(text)]
    return sorted(x for x in out if not any(s < x[2] and x[0] < e for s, _, e, _ in base))


def scan_row(text: str | None) -> tuple[int, int, int, list[dict]]:
    base = base_spans(text or "")
    n = Counter(k for _, k, _, _ in base)
    found = [
        {"kind": k, "start": s, "end": e, "digest": hashlib.sha256(v.encode()).hexdigest(), "entropy": entropy(v)}
        for s, k, e, v in [*base, *further_spans(text or "", base)]
    ]
    return n[0], n[1], n[2], found


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns of every row with what its whole text holds: base counts, and base spans and further candidates."""
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = list(map(scan_row, frame.pop("__text")))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "found"])], axis=1)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.select(*(f.name for f in fields), F.col(text_col).alias("__text")).mapInPandas(run, ", ".join([*kept, FOUND]))


def ownership(candidates: DataFrame) -> DataFrame:
    """digest to n_repositories, n_owners, entropy, example and live, from rows (digest, repository, owner, entropy).

    Distinct pairs are formed first, so a digest that a third of the corpus holds is spread by its owners and
    repositories; then only counts meet by digest, one row for each map task.
    """
    by_owner = candidates.groupBy("digest", "owner").agg(F.max("entropy").alias("entropy"))
    owners = by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.max("entropy").alias("entropy"))
    by_repository = candidates.groupBy("digest", "repository").agg(F.lit(1).alias("one"))
    repositories = by_repository.groupBy("digest").agg(F.count(F.lit(1)).alias("n_repositories"))
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    live = ~F.col("example") & (F.col("entropy") >= LIVE_ENTROPY)
    return owners.join(repositories, "digest").withColumn("example", example).withColumn("live", live)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, owner, base counts, `base` and `spans` (arrays of start, kind, end): all
    base spans, and with them the further ones that are live; n_live and n_example count the values among all found."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text"), *keep)
    scanned = as_table(scan(named, keep=("doc_id", "owner", *keep)).withColumn("__row", F.monotonically_increasing_id()))
    each = scanned.where(F.size("found") > 0).select("__row", "doc_id", "owner", F.explode("found").alias("f")).select(
        "__row", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("__row"))).alias("repository"), "owner", "f.*"
    )
    owned = ownership(each.select("digest", "repository", "owner", "entropy")).select("digest", "live", "example")
    span, base = F.struct("start", "kind", "end"), F.col("kind") < len(BASE)
    judged = (
        each.join(owned, "digest")
        .groupBy("__row")
        .agg(
            F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
            F.sort_array(F.collect_list(F.when(base | F.col("live"), span))).alias("spans"),
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum(F.col("example").cast("long")).alias("n_example"),
        )
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.drop("found").join(judged, "__row", "left").select(
        "doc_id", "owner", *keep, "n_assign", "n_access", "n_hex",
        *(F.coalesce(c, none).alias(c) for c in ("base", "spans")),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")),
    )


def span_names(spans) -> F.Column:
    """`kind:start:end` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")



def redacted(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """docs with `mark` in place of every base span and every live further span; `length_col`, if docs has it, counts anew.

    What is found depends on a text and the corpus, so spans are joined to texts by the digest of the text.
    """
    columns = docs.columns
    key = lambda c: F.unhex(F.md5(F.coalesce(F.col(c), F.lit(""))))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("source"), F.col(text_col).alias("text"), key(text_col).alias("text_key"))
    spans = find_secrets(named, keep=("text_key",)).where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("spans"))
    spans = as_table(spans)  # joined as a table, so that a frequent text can be split
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(text_col).alias("text"), key(text_col).alias("text_key"))
    joined = rows.join(spans, "text_key", "left")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.when(s["start"] >= a["at"], mark).otherwise("")).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(covered)
    out = joined.withColumn("clean", text)
    value = lambda i, c: F.col("clean") if c == text_col else F.length("clean").cast(docs.schema[c].dataType) if c == length_col else F.col(f"c{i}")
    return out.select(*(value(i, c).alias(c) for i, c in enumerate(columns)))
