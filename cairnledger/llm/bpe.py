"""Byte-level BPE encoding and decoding by a pair occurrence index.

Within a slice of a partition, every adjacent pair that some merge rule names is indexed to all its positions.
The active ranks are applied in ascending order; each application rewrites all positions of its pair at once
and adds the pairs that it creates to the lists of their ranks. Positions that have gone stale are dropped when
their list is read. Words (white space and what follows it) are stored once per slice, as their ids do not
depend on their neighbours.

Defined results: a null text is an empty text; an empty text has no ids; repeated rows are encoded alike; a text longer than a
slice is a slice of its own and stays whole; an empty table gives none; other columns of the input are kept and may have any names but
those of the output columns. A vocabulary file with settings that this encoder doesn't follow is refused.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: The pattern that the byte-level pre-tokenizer splits by, and Unicode's white space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\x20\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Bytes of text whose words are encoded together, and the distinct words that a worker keeps.
SLICE_BYTES = 8 << 20
KEPT_WORDS = 200_000


def printable_bytes() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself where it prints, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def refuse_other_settings(spec: dict) -> None:
    """Raises ValueError if a tokenizer file asks for anything but plain byte-level BPE."""
    model, split, decoder = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
    plain = model.get("type", "BPE") == "BPE" and split.get("type") == decoder.get("type") == "ByteLevel"
    unused = [spec.get("normalizer"), split.get("add_prefix_space"), not split.get("use_regex", True)]
    unused += [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    unused += [t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    if not plain or any(unused):
        raise ValueError("the tokenizer file has settings that this encoder does not follow")


def gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs named by `which`, one after another, of `flat`, which holds runs of these lengths in a row."""
    starts, chosen = np.cumsum(lengths) - lengths, lengths[which]
    shift = starts[which] - (np.cumsum(chosen) - chosen)
    return flat[np.repeat(shift, chosen) + np.arange(int(chosen.sum()))]


class PairIndexBpe:
    """A vocabulary with its merge rules, read from a `tokenizers` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_other_settings(spec)
        model, chars = spec["model"], printable_bytes()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(chars[c] for c in token)
        self.token_bytes = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.pretoken = regex.compile(PRETOKEN)
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 where no rule merges it."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode_pretokens(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pretokens in a row, and how many each has, by the pair occurrence index over all of them."""
        if not pretokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        flat = np.frombuffer(b"".join(pretokens), np.uint8)
        # One stop symbol stands before every pretoken and one at the end, so that no pair crosses pretokens.
        starts = np.cumsum(lengths) - lengths + np.arange(1, len(lengths) + 1)
        symbols = np.full(len(flat) + len(lengths) + 1, -1, np.int64)
        place = np.ones(len(symbols), bool)
        place[starts - 1] = place[-1] = False
        symbols[place] = self.of_byte[flat]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)

        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            by = np.argsort(ranks, kind="stable")
            positions, ranks = positions[by], ranks[by]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for begin, end in zip(edges, [*edges[1:], len(ranks)], strict=True):
                rank = int(ranks[begin])
                if rank not in lists:
                    lists[rank] = []
                    heapq.heappush(active, rank)
                lists[rank].append(positions[begin:end])

        def pair_ranks(positions: np.ndarray) -> np.ndarray:
            a, b = symbols[positions], symbols[after[positions]]
            inside = (a >= 0) & (b >= 0)
            return np.where(inside, self.ranks(np.where(inside, a, 0), np.where(inside, b, 0)), -1)

        first = np.flatnonzero(place[:-1])
        add(first, pair_ranks(first))
        while active:
            rank = heapq.heappop(active)
            at = np.sort(np.concatenate(lists.pop(rank)))
            at = at[np.diff(at, prepend=-1) > 0]
            left, right = self.left[rank], self.right[rank]
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:  # of overlapping occurrences, every second one from the left
                run_start = np.ones(len(at), bool)
                run_start[1:] = after[at[:-1]] != at[1:]
                begin = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.made[rank]
            symbols[gone] = -2
            after[at] = after[gone]
            before[after[at]] = at
            touched = np.concatenate([before[at], at])
            add(touched, pair_ranks(touched))
        left_over = np.flatnonzero(symbols >= 0)
        ends = np.searchsorted(left_over, starts + lengths)
        return symbols[left_over].astype(np.int32), np.diff(ends, prepend=0)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each chunk has; a special token's text is that token."""
        part_of: dict[bytes | int, int] = {}
        parts, counts = [], []
        for c in chunks:
            if (c[1:] if c[0] == " " else c).isalpha():  # one run of letters, as most words are
                cut = [c.encode()]
            elif c in self.special:
                cut = [self.special[c]]
            else:
                cut = [p.encode() for p in self.pretoken.findall(c)]
            for p in cut:
                parts.append(part_of.setdefault(p, len(part_of)))
            counts.append(len(cut))
        distinct = [p for p in part_of if isinstance(p, bytes)]
        flat, lengths = self.encode_pretokens(distinct)
        special = [p for p in part_of if isinstance(p, int)]
        place = np.zeros(len(part_of), np.int64)
        for n, p in enumerate([*distinct, *special]):
            place[part_of[p]] = n
        flat = np.concatenate([flat, np.array(special, np.int32)])
        lengths = np.concatenate([lengths, np.ones(len(special), np.int64)])
        which = place[np.array(parts, np.int64)]
        ends = np.cumsum(np.concatenate([[0], lengths[which]]))[np.cumsum([0, *counts])]
        return gather(flat, lengths, which), np.diff(ends)

    def chunks_of(self, text: str) -> list[str]:
        """Parts that can be encoded apart: a special token's text, or white space with what follows it."""
        if self.split_special is None or not self.split_special.search(text):
            return self.chunk.findall(text)
        out, done = [], 0
        for m in self.split_special.finditer(text):
            out += [*self.chunk.findall(text[done : m.start()]), m.group()]
            done = m.end()
        return out + self.chunk.findall(text[done:])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class Encoder:
    """Encodes slices of texts; keeps the words of the last slices up to a bound."""

    def __init__(self, path: str):
        self.bpe = PairIndexBpe(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known, fresh, places = self.known, [], []
        for text in texts:
            chunks = self.bpe.chunks_of(text or "")
            new = set(chunks).difference(known)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            fresh += new
            places.append(np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks)))
        flat, lengths = self.bpe.encode_chunks(fresh)
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        which = np.concatenate([np.zeros(0, np.int64), *places])
        ends = np.cumsum(np.concatenate([[0], self.lengths[which]]))[np.cumsum([0, *map(len, places)])]
        return gather(self.flat, self.lengths, which), np.diff(ends)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(
    docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, decoded_col: str | None = None
) -> DataFrame:
    """docs with the token ids of each whole text in `ids_col` (array of int). The text stays, unless `keep` omits it.
    With `decoded_col` the ids are decoded in the same pass, into a column of that name."""
    columns = docs.columns if keep is None else keep
    made = [ids_col, *([decoded_col] if decoded_col else [])]
    fields = [f for f in docs.schema.fields if f.name in columns and f.name not in made]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in text_slices(batches, "__text", SLICE_BYTES):
            flat, lengths = enc.texts(part.column("__text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded_col:
                ends = offsets.tolist()
                out.append(pa.array([enc.bpe.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *out], [*names, *made])

    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    if decoded_col:
        schema = schema.add(decoded_col, T.StringType(), False)
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in `text_col`; bytes that are not UTF-8 become U+FFFD; null ids are an empty text."""
    fields = [f for f in encoded.schema.fields if f.name != text_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer).bpe
        for batch in batches:
            rows = batch.column("__ids")
            texts = [bpe.decode(r.values.to_numpy()).decode("utf-8", "replace") if r.is_valid else "" for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    schema = T.StructType([*fields, T.StructField(text_col, T.StringType(), False)])
    return encoded.select(*names, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
