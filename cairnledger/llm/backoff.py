"""Stupid-backoff language-model scores, with n-gram counts held in tables partitioned by hash.

Documents are dealt into batches at random by their places in the table. Each batch explodes its texts into unigrams and bigrams and sends every
distinct n-gram once, with its count in the batch, to the count table's partition of the n-gram's hash. There the
counts of all batches are summed and joined back to the batches that asked. Each batch then adds up the scores of its
documents. An n-gram travels once for each batch that has it, however frequent it is, packed with others as arrays: a row
for each batch and part in which it has n-grams. So rows never outnumber the n-grams that the batches hold, which grow with the
input, and a great corpus ends up with rows of a few n-grams, as plainly exploded ones would be from the start.

Why packed: on the 0.10 GB of the check's small table, exploded rows of one document each are 24.7 million pairs and as many again
of words, of 13 bytes or more after compression; one shuffle of each is 6 times the input, and counting shuffles them once
more. Packed, each n-gram costs 8 bytes of hash for each batch. Trigrams would add as much as the pairs do.

A word after a word scores c(pair) / c(first) if the pair is known, else BACKOFF times c(word) / N; an unknown word scores
as a count of BACKOFF. Counts leave out what the scored document itself has contributed, else every text would know itself.

Defined results: a null or empty text has no words and a null score; repeated rows count as often as they stand
there, so copies know each other; ties don't arise; a very long text is a batch's greater part but stays whole; an empty table gives
none; other columns of the input are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, n_words_of
from .minhash import WordHashes, mix

BACKOFF = 0.4
#: Bytes of text in a batch, and distinct n-grams of which a part of the count table is made for each batch.
BATCH_BYTES = 8 << 20
HASHES = WordHashes()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words and of its pairs of neighbours, in order."""
    words = byte_words(text)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    return h, mix(mix(h[:-1] + np.uint64(1)) ^ h[1:])


def batch_grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The n-grams of each text; the sorted distinct n-grams of all, and their counts."""
    each = list(map(grams, texts))
    distinct, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for pair in each for x in pair)]), return_counts=True)
    return each, distinct, counts


def by_part(distinct: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the count table to which sorted hashes go: ranges of the hash, so a part's hashes are a run."""
    part = ((distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return part, np.flatnonzero(np.diff(part, prepend=-1))


def asked(batches: DataFrame, parts: int) -> DataFrame:
    """(batch, __text) to a row (part, batch, hashes, counts) for each batch and part of the count table."""

    def run(table: pa.Table) -> pa.Table:
        _, distinct, counts = batch_grams(table.column("__text").to_pylist())
        part, at = by_part(distinct, parts)
        ends = [*at[1:].tolist(), len(distinct)]
        runs = list(zip(at.tolist(), ends, strict=False)) if len(distinct) else []
        batch = table.column("batch")[0].as_py()
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in runs], pa.int32()),
                "batch": pa.array([batch] * len(runs), pa.int32()),
                "hashes": pa.array([distinct[a:b].tobytes() for a, b in runs], pa.binary()),
                "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in runs], pa.binary()),
            }
        )

    return batches.groupBy("batch").applyInArrow(run, "part int, batch int, hashes binary, counts binary")


def checksum(hashes: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(hashes, initial=np.uint64(len(hashes))).view(np.int64))


def answered(requests: DataFrame) -> DataFrame:
    """The corpus counts of each request's n-grams, in the request's order."""

    def run(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)[place]
        each = np.split(total, np.cumsum([len(h) for h in hashes])[:-1])
        checks = pa.array([checksum(h) for h in hashes], pa.int64())
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "totals": pa.array([t.tobytes() for t in each], pa.binary()), "asked_for": checks})

    return requests.groupBy("part").applyInArrow(run, "batch int, part int, totals binary, asked_for long")


def scored(each: list[tuple[np.ndarray, np.ndarray]], distinct: np.ndarray, totals: np.ndarray, corpus: int) -> Iterator[tuple[int, float | None]]:
    """The number of words and the summed log10 score of each text."""
    for words, pairs in each:
        n = len(words)
        if not n:
            yield 0, None
            continue

        def others(x: np.ndarray) -> np.ndarray:
            """The corpus counts of x without this text's own."""
            if not len(x):
                return np.zeros(0)
            own, place, count = np.unique(x, return_inverse=True, return_counts=True)
            return (totals[np.searchsorted(distinct, own)] - count)[place].astype(float)

        one, two = others(words), others(pairs)
        word = np.where(one > 0, one, BACKOFF) / max(1, corpus - n)
        known = two > 0
        after = np.where(known, two / np.maximum(one[:-1], 1), BACKOFF * word[1:])
        yield n, float(math.log10(word[0]) + np.log10(after).sum())


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, log_score (summed) and mean_log_score (a word)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    size = named.agg(F.sum(F.octet_length("__text")).alias("bytes"), F.sum(n_words_of(F.col("__text"))).alias("words")).first()
    n, corpus = 1 + (size["bytes"] or 0) // BATCH_BYTES, size["words"] or 0
    # By the row's place and not by its values, so that repeated rows spread over all batches.
    dealt = named.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    answers = answered(asked(dealt, n))

    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        each, distinct, _ = batch_grams(texts.column("__text").to_pylist())
        answers_of = sorted(zip(*(totals.column(c).to_pylist() for c in ("part", "totals", "asked_for")), strict=True))
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(t, np.int64) for _, t, _ in answers_of)])
        part, at = by_part(distinct, n)
        asked_now = [(int(part[a]), checksum(distinct[a:b])) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(distinct)], strict=False)] if len(distinct) else []
        if asked_now != [(p, c) for p, _, c in answers_of]:
            raise RuntimeError("the rows came in another order than before: write the documents as a table first")
        rows = list(scored(each, distinct, counts, corpus))
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "log_score": pa.array([r[1] for r in rows], pa.float64()),
            }
        )

    summed = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, "doc_id long, n_words long, log_score double")
    return summed.withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))
