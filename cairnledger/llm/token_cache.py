"""Token counts through a digest cache.

A content is known by the digest of its normalised text and counted under the digest of a tokenizer's file. The
cache is a Parquet table of (content_digest, tokenizer_digest, n_tokens) in a shared folder. A run joins its
contents to the stored counts, encodes each distinct miss once, appends the new counts, and reads them back.

Defined results: a null text counts as an empty text and has no tokens; equal texts are encoded once; an append
that is repeated after a lost executor may store a digest twice, so readers take one count for each digest (the
counts are equal, being a function of text and tokenizer); a text longer than a slice is a slice of its own and stays whole; an empty
table gives none, and leaves the cache as it was; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import as_table, text_slices

SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
SLICE_BYTES = 8 << 20
KEPT_WORDS = 400_000


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceCounter:
    """Counts the pieces of texts. Where no piece of the vocabulary runs on over a space into the next word, a word
    with the spaces before it is counted by itself, and words met before are not encoded again."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any("▁" in p[1:] and p.strip("▁") for p in pieces) and self._keeps_spaces()
        self.words = re.compile(" *[^ ]+| +")
        self.known: dict[str, int] = {}

    def _keeps_spaces(self) -> bool:
        """Whether texts reach the pieces as they are, with one space put before them."""
        probe = "  a  Ａ \n b  "
        ids = self.model.encode(probe)
        return self.model.decode(ids) in (probe, " " + probe) and self.model.encode("a", out_type=str)[0].startswith("▁")

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.apart:
            return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, split = self.known, []
        for text in texts:
            # The model itself puts a space before a text; the mark that it writes for spaces is a space too.
            split.append(self.words.findall(" " + text.replace("▁", " ")) if text else [])
        new = list(set().union(*map(set, split)).difference(known)) if split else []
        # A word is handed over without one of its spaces, which the model puts back. A lone space would be nothing.
        counts = self.model.encode([w[1:] for w in new], num_threads=1)
        known.update((w, len(c) if len(w) > 1 else 1) for w, c in zip(new, counts, strict=True))
        return [sum(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def encode_counts(contents: DataFrame, tokenizer: str) -> DataFrame:
    """(content_digest, __text) to (content_digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text", SLICE_BYTES):
            n = counter(tokenizer).count(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(np.array(n, np.int64))], ["content_digest", "n_tokens"])

    return contents.select("content_digest", "__text").mapInArrow(run, "content_digest binary, n_tokens long")


def stored_counts(spark, cache: str, version: str) -> DataFrame | None:
    """The stored counts of one tokenizer version; None if there is no cache yet."""
    try:
        table = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    counts = table.where(F.col("tokenizer_digest") == version)
    return counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the `keep` columns, n_bytes and n_tokens of the whole text."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("__text")).withColumn("content_digest", F.unhex(F.sha2("__text", 256)))
    held = stored_counts(spark, cache, version)
    misses = rows.select("content_digest", "__text")
    if held is not None:
        misses = misses.join(held, "content_digest", "left_anti")
    # Equal contents meet as one row of every map task before they are shuffled.
    distinct = misses.groupBy("content_digest").agg(F.first("__text").alias("__text"))
    fresh = encode_counts(distinct, tokenizer).withColumn("tokenizer_digest", F.lit(version))
    fresh.select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache)
    known = as_table(stored_counts(spark, cache, version))  # joined as a table, so a frequent digest can be split
    narrow = as_table(rows.select(*keep, "content_digest", F.octet_length("__text").cast("long").alias("n_bytes")))
    return narrow.join(known, "content_digest").select(*keep, "n_bytes", "n_tokens")
