"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts.

A text with a space before it is cut by both tokenizers into tokens that tile its bytes. Tokens of both are intervals on one line, on which the texts of
a part follow one another. Sorted by start, with the running maximum of their ends, a group breaks where a start reaches that maximum, which is where
tokens of both end; within a group, the tokens of B that overlap one of A are a run, found by two binary searches and expanded.

A pair's count is the number of documents that hold it linked. Each slice of a task (about SLICE_BYTES of text) writes its documents with their distinct pairs
and how often each is linked, and once for the slice, how many of its documents hold each of its pairs. Only the latter rows, one for each slice and pair,
are summed over the corpus, compared with the highest of their A token, and joined back; they then meet their slice's documents, so neither links nor
pairs of single documents are ever exploded, and no table is broadcast.

Defined results: texts that are null or empty, and those that the tokens of either do not give back byte for byte, have no tokens: zeros, and no groups.
Rows are kept as they are, repeated ones and null ids too, and each is a document for the counts. A text longer than a slice is a slice of its own and stays
whole; an empty table gives none; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRETOKEN, printable_bytes, refuse_other_settings
from .common import as_table, text_slices

#: Bytes of text that are aligned at once, and that share one list of pairs.
PART_BYTES, SLICE_BYTES = 2 << 20, 16 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def ranked(path: str) -> dict[bytes, int] | None:
    """The tokens of a plain byte-level BPE file as ranks, if its ids are these: bytes first, then what the merge rules make, in their order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        refuse_other_settings(spec)
    except ValueError:
        return None
    vocab, chars = spec["model"]["vocab"], printable_bytes()
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    if sorted(vocab[c] for c in chars) != list(range(256)) or [vocab[m] for m in made] != list(range(256, 256 + len(made))):
        return None
    return {bytes(chars[c] for c in t): vocab[t] for t in [*chars, *made]}


class Side:
    """One tokenizer: the ids of texts with a space before them, special tokens being plain text, and the bytes of every id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            byte = re.compile(r"<0x([0-9A-F]{2})>")
            token_bytes = [bytes([int(byte.fullmatch(p)[1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self.encode = lambda texts: model.encode(texts, num_threads=1)  # the model puts the space itself
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
            from tokenizers import Tokenizer

            known = Tokenizer.from_file(path)
            known.encode_special_tokens = True
            known.no_truncation()
            known.no_padding()
            chars, vocab = printable_bytes(), known.get_vocab(with_added_tokens=False)
            token_bytes = [b""] * (max(known.get_vocab().values()) + 1)
            for token, i in vocab.items():
                token_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
            if ranks := ranked(path):
                # The same ids, from a library that needs a quarter of the time, as it keeps no offsets.
                fast = tiktoken.Encoding("ranked", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
                self.encode = lambda texts: fast.encode_ordinary_batch([" " + t for t in texts], num_threads=1)
            else:
                self.encode = lambda texts: [e.ids for e in known.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        self.size = len(token_bytes)
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


@dataclass
class Aligned:
    """The aligned tokens of some texts in a row. a, b: ids; of_a, of_b: the text of each; group_a, group_b: its group, numbered over all texts;
    link_a, link_b: the tokens of each link; cuts: where the groups begin in bytes, and where the last ends."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cuts: np.ndarray
    base: np.ndarray  # where each text begins


def tokens_of(texts: list[str | None], path_a: str, path_b: str) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """The ids of both tokenizers for each text, none unless both give back its bytes; and the bytes of each text that has tokens."""
    a, b = side(path_a), side(path_b)
    some = [t or "" for t in texts]
    out_a, out_b, sizes = [], [], []
    for text, x, y in zip(some, a.encode(some), b.encode(some), strict=True):
        whole = b" " + text.encode()
        same = text != "" and all(b"".join(map(s.bytes.__getitem__, ids)) == whole for s, ids in ((a, x), (b, y)))
        out_a.append(x if same else [])
        out_b.append(y if same else [])
        sizes.append(len(whole) if same else 0)
    return out_a, out_b, sizes


def coalesce(texts: list[str | None], path_a: str, path_b: str) -> Aligned:
    """Groups and links of the tokens of texts."""
    ids_a, ids_b, sizes = tokens_of(texts, path_a, path_b)
    flat = lambda ids: np.array(list(chain.from_iterable(ids)), np.int64)
    of = lambda ids: np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    a, b = flat(ids_a), flat(ids_b)
    base = np.cumsum([0, *sizes])
    end_a, end_b = np.cumsum(side(path_a).lengths[a]), np.cumsum(side(path_b).lengths[b])
    start_a, start_b = end_a - side(path_a).lengths[a], end_b - side(path_b).lengths[b]
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((-ends, starts))
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    # Of A's token [s, e), B's tokens from the first that ends behind s to the last that begins before e.
    first, beyond = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    many = beyond - first
    link_a = np.repeat(np.arange(len(a)), many)
    link_b = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    cuts = np.concatenate([starts[order][breaks], base[-1:]])
    return Aligned(a, b, of(ids_a), of(ids_b), group[: len(a)], group[len(a) :], link_a, link_b, cuts, base)


@lru_cache(maxsize=2)
def printed(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """How each id of A and of B is written with what follows it: within its list, and at the list's end."""
    write = lambda n, ends: np.array([f"{i}{e}" for e in ends for i in range(n)], object)
    return write(side(path_a).size, ",|"), write(side(path_b).size, ",;")


def group_texts(x: Aligned, n: int, path_a: str, path_b: str) -> list[str]:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
    written_a, written_b = printed(path_a, path_b)
    last = lambda group: np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
    parts = np.concatenate([written_a[x.a + side(path_a).size * last(x.group_a)], written_b[x.b + side(path_b).size * last(x.group_b)]])
    order = np.argsort(np.concatenate([x.group_a * 2, x.group_b * 2 + 1]), kind="stable")
    in_order = parts[order].tolist()
    ends = np.cumsum(np.bincount(x.of_a, minlength=n) + np.bincount(x.of_b, minlength=n))
    return ["".join(in_order[begin:end])[:-1] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]


def document_schema(docs: DataFrame, id_col: str, pair: str) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    return f"slice long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<{pair}>, times array<int>, is_list boolean"


def linked_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with its counts, the digest of its groups, its distinct pairs and how often each is linked; and with is_list, a row for
    each slice: all its pairs, and how many of its documents hold each."""
    width = side(path_b).size
    pair = "int" if side(path_a).size * width < 2**31 else "bigint"
    schema = document_schema(docs, id_col, pair)
    number = pa.int32() if pair == "int" else pa.int64()

    def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))

    def row(ids: pa.Array, at: int, counts: list[np.ndarray], hashes: list[str], pairs: pa.ListArray, times: pa.ListArray, is_list: bool) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array([at] * n, pa.int64()), ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pairs, times, pa.array([is_list] * n)]
        return pa.RecordBatch.from_arrays(columns, ["slice", "doc_id", *COUNTS, "groups_sha256", "pairs", "times", "is_list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, whole in enumerate(s for batch in batches for s in text_slices([batch], text_col, SLICE_BYTES)):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for part in text_slices([whole], text_col, PART_BYTES):
                texts = part.column(text_col).to_pylist()
                n = len(texts)
                x = coalesce(texts, path_a, path_b)
                of_link = x.of_a[x.link_a]
                linked = x.a[x.link_a] * width + x.b[x.link_b]
                order = np.lexsort((linked, of_link))
                new = np.ones(len(order), bool)
                new[1:] = (linked[order][1:] != linked[order][:-1]) | (of_link[order][1:] != of_link[order][:-1])
                at = np.flatnonzero(new)
                distinct, times = linked[order][at], np.diff(np.append(at, len(order)))
                own = np.bincount(of_link[order][at], minlength=n)
                groups = np.bincount(x.of_a[np.flatnonzero(np.append(True, x.group_a[1:] != x.group_a[:-1]))] if len(x.a) else x.of_a, minlength=n)
                counts = [np.bincount(x.of_a, minlength=n), np.bincount(x.of_b, minlength=n), groups, np.bincount(of_link, minlength=n)]
                hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(x, n, path_a, path_b)]
                yield row(part.column(id_col), first + k, counts, hashes, lists(distinct, own, number), lists(times, own, pa.int32()), False)
                held.append(np.unique(distinct, return_counts=True))
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            docs_of = np.zeros(len(pairs), np.int64)
            np.add.at(docs_of, where, np.concatenate([c for _, c in held]))
            empty = [np.zeros(1, np.int64)] * len(COUNTS)
            yield row(pa.nulls(1, whole.column(id_col).type), first + k, empty, [""], lists(pairs, np.array([len(pairs)]), number), lists(docs_of, np.array([len(pairs)]), pa.int32()), True)

    return as_table(docs.select(id_col, text_col).mapInArrow(run, schema))


def pair_counts(lists: DataFrame, width: int) -> DataFrame:
    """(pair, n, is_best): how many documents hold each pair, and whether no pair of its A token has more; from (pair, docs)."""
    counts = as_table(lists.groupBy("pair").agg(F.sum("docs").alias("n")))
    token = F.floor(F.col("pair") / width).cast("int")
    highest = counts.groupBy(token.alias("token")).agg(F.max("n").alias("most"))
    return as_table(counts.withColumn("token", token).join(highest, "token").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    width = side(path_b).size
    held = linked_documents(docs, path_a, path_b, id_col, text_col)
    listed = held.where("is_list").select("slice", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("slice", F.col("x.pairs").alias("pair"), F.col("x.times").alias("docs"))
    counts = listed.select(F.col("slice").alias("of_slice"), "pair").join(pair_counts(listed, width), "pair")
    kind = held.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string"

    def meet(own: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows:  # texts without tokens only
            known = pa.table({"pair": pa.array([-1], own.schema.field("pairs").type.value_type), "n": pa.array([0], pa.int64()), "is_best": pa.array([False])})
        pairs = known.column("pair").to_numpy()
        order = np.argsort(pairs)
        own = own.combine_chunks()
        flat = lambda c: own.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False)
        at = order[np.searchsorted(pairs[order], flat("pairs"))] if own.num_rows else np.zeros(0, np.int64)
        times = flat("times").astype(np.int64) if own.num_rows else at
        ends = np.append(0, np.cumsum(pa.compute.list_value_length(own.column("pairs")).to_numpy()))
        total = lambda v: np.diff(np.append(0, np.cumsum(v))[ends])
        n, best = known.column("n").to_numpy()[at], known.column("is_best").to_numpy(zero_copy_only=False)[at]
        sums = {"n_best": pa.array(total(times * best), pa.int64()), "count_sum": pa.array(total(times * n), pa.int64())}
        return pa.table({"doc_id": own.column("doc_id"), **{c: own.column(c) for c in COUNTS}, **sums, "groups_sha256": own.column("groups_sha256")})

    rows = held.where("NOT is_list").drop("is_list")
    return rows.groupBy("slice").cogroup(counts.groupBy("of_slice")).applyInArrow(meet, schema)


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: doc_id, number, begin, end (bytes of the text with its space), a, b (ids), and links (place in a, place in b)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, PART_BYTES):
            x = coalesce(part.column(text_col).to_pylist(), path_a, path_b)
            ids, rows = part.column(id_col).to_pylist(), []
            first = {"a": np.searchsorted(x.group_a, np.arange(len(x.cuts))), "b": np.searchsorted(x.group_b, np.arange(len(x.cuts)))}
            links = defaultdict(list)
            for i, j in zip(x.link_a.tolist(), x.link_b.tolist(), strict=True):
                g = int(x.group_a[i])
                links[g].append({"a": i - int(first["a"][g]), "b": j - int(first["b"][g])})
            number, before = 0, -1
            for g in range(len(x.cuts) - 1):
                doc = int(x.of_a[first["a"][g]])
                number, before = (number + 1 if doc == before else 0), doc
                rows.append({
                    "doc_id": ids[doc], "number": number, "begin": int(x.cuts[g] - x.base[doc]), "end": int(x.cuts[g + 1] - x.base[doc]),
                    "a": x.a[first["a"][g] : first["a"][g + 1]].tolist(), "b": x.b[first["b"][g] : first["b"][g + 1]].tolist(), "links": links[g],
                })
            link = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", part.schema.field(id_col).type), ("number", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("links", link)]))

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, number long, begin long, end long, a array<long>, b array<long>, links array<struct<a int, b int>>")
