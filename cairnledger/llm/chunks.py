"""Substring deduplication by content-defined chunking with a gear rolling hash.

The words of a text, A-Z lowered, are cut into chunks. A gear hash of the last eight bytes is taken at the end of each word; a cut
is made after each word whose hash is the least of some WINDOW consecutive words (the last one of equals). So a cut depends on
the bytes around it alone, an insertion moves no cuts but those near it, a passage has the same cuts wherever it stands, and no
chunk is longer than WINDOW words. Chunks are variable; each is known by the digest of it and of as many following chunks as it takes
to reach LEAST_WORDS words, and these digests are matched over the corpus. The words under matched digests are repeated passages.

Any passage of SURE_WORDS words or more that stands in two rows is found, but for up to 12 words at its begin and 15 at its end, whose
chunks may reach beyond it. Any word that is reported belongs to LEAST_WORDS consecutive words that stand in another row too.

Defined results: a null or empty text has no chunk, and a text of fewer than LEAST_WORDS words no passage; repeats inside one
row don't count, nor does it matter how often a row has a chunk; rows are documents, so rows that are equal repeat each
other, and of equal rows the one with the least number is first; positions count words and ends are exclusive; texts of any length are
whole; an empty table gives none; other columns of the input are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WORD, as_table, byte_words, text_slices

#: Bytes the gear hash looks back on (a power of two), consecutive words of which one at least is cut after, words that make a match, and
#: words of which a repeated passage is always found: a cut within 12 words, a match of 24 and up to 7 more, and 7 words to spare.
LOOK_BACK, WINDOW, LEAST_WORDS, SURE_WORDS = 8, 8, 24, 50
GEAR = np.random.Generator(np.random.PCG64(577)).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
SPREAD = np.uint32(0x9E3779B1)
SLICE_BYTES = 8 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last LOOK_BACK bytes at each byte: the sum of their gears, each shifted by its age."""
    h, span = GEAR[data], 1
    while span < LOOK_BACK:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts(hashes: np.ndarray) -> np.ndarray:
    """The words after which a text is cut, given the hash at the end of each: the last least one of every WINDOW words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINDOW)
    return np.unique(len(hashes) - 1 - (windows.argmin(axis=1) + np.arange(len(windows))))


def matches_of(text: str | None) -> tuple[list[int], np.ndarray]:
    """The digests of a text's chunks, each with the following ones up to LEAST_WORDS words, and the words they cover, as
    start << 32 | end."""
    data = b" ".join(byte_words(text))
    if not data:
        return [], np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    at = np.unique(np.concatenate([[0], cuts(gear(raw)[ends - 1] * SPREAD) + 1, [len(ends)]]))
    stop = np.searchsorted(at, at + LEAST_WORDS)
    start, stop = at[stop < len(at)], at[stop[stop < len(at)]]
    begins = np.where(start > 0, ends[start - 1] + 1, 0).tolist()
    return [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begins, ends[stop - 1].tolist(), strict=True)], start << 32 | stop


def chunked(rows: DataFrame) -> DataFrame:
    """(row, doc_id, __text) to (row, doc_id, digests, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text", SLICE_BYTES):
            found = list(map(matches_of, part.column("__text").to_pylist()))
            digests = pa.array([np.array(d, np.uint64).view(np.int64) for d, _ in found], pa.list_(pa.int64()))
            spans = pa.array([s for _, s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), digests, spans], ["row", "doc_id", "digests", "spans"])

    return rows.select("row", "doc_id", "__text").mapInArrow(run, "row long, doc_id long, digests array<long>, spans array<long>")


def matched(rows: DataFrame) -> DataFrame:
    """(row, doc_id, start, end, is_first) of every match of rows (row, doc_id, digests, spans) whose digest another row has too."""
    # The first and last row that hold a digest tell whether two do; a digest of any frequency has one partial a task.
    held = rows.select(F.explode(F.array_distinct("digests")).alias("digest"), "row").groupBy("digest").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    # As a table, so that the rows of a digest that very many texts have can be split in the join.
    repeated = as_table(held.where("low < high").select("digest", "low"))
    each = rows.select("row", "doc_id", F.explode(F.arrays_zip(F.col("digests").alias("digest"), F.col("spans").alias("span"))).alias("m")).select("row", "doc_id", "m.*")
    found = each.join(repeated, "digest").select("row", "doc_id", "span", (F.col("low") == F.col("row")).alias("is_first"))
    return as_table(found.select("row", "doc_id", F.shiftright("span", 32).cast("int").alias("start"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end"), "is_first"))


def joined_spans(found: DataFrame) -> DataFrame:
    """(row, doc_id, start_word, end_word, n_matches, is_first) of the stretches that overlapping or touching matches cover."""
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum((F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")).over(order)
    return found.withColumn("stretch", stretch).groupBy("row", "stretch").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.count(F.lit(1)).alias("n_matches"), F.bool_and("is_first").alias("is_first")
    ).drop("stretch")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each repeated passage of each document: doc_id, start_word, end_word, n_words, n_matches and is_first, which
    says that no row before (in the order of the rows' numbers) holds any match of it."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    passages = joined_spans(matched(as_table(chunked(named))))
    return passages.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_matches", "is_first")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of sorted, disjoint spans; the white space before each of these words goes with it."""
    words = [m.span() for m in re.finditer(WORD, text)]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : words[start - 1][1] if start else 0])
        done = words[end - 1][1]
    return "".join([*out, text[done:]])


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([without_words(t, list(zip(a, b, strict=True))) if a is not None else t for t, a, b in zip(text, starts, ends, strict=True)], dtype=object)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs with their columns, without the passages that a row before holds; `length_col`, if docs has it, counts anew."""
    columns = docs.columns
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    rows = as_table(named.withColumn("row", F.monotonically_increasing_id()))
    again = joined_spans(matched(as_table(chunked(rows))).where("NOT is_first")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("gone"))
    joined = rows.drop("doc_id").join(as_table(again), "row", "left")
    clean = joined.withColumn("clean", F.when(F.col("gone").isNull(), F.col("__text")).otherwise(kept_text("__text", "gone.start_word", "gone.end_word")))

    def value(i: int, c: str) -> Column:
        return F.col("clean") if c == text_col else F.length("clean").cast(docs.schema[c].dataType) if c == length_col else F.col(f"c{i}")

    return clean.select(*(value(i, c).alias(c) for i, c in enumerate(columns)))
