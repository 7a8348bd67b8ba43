"""Token alignment against a byte-by-byte version."""

import collections
import functools
import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnledger.llm import alignment, queries
from cairnledger.llm.bpe import printable_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache
def loaded():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), printable_bytes()


def tokens(text):
    """Both tokenizers' (id, begin, end), or None."""
    if not text:
        return None
    t, s, chars = loaded()
    a = [(i, bytes(chars[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in s.encode(text):
        p = s.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    out = []
    for side in (a, b):
        placed, at = [], 0
        for i, x in side:
            placed.append((i, at, at + len(x)))
            at += len(x)
        out.append(placed)
    return out


def groups_of(a, b):
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    out, begin = [], 0
    for c in cuts:
        out.append(([t for t in a if begin <= t[1] and t[2] <= c], [t for t in b if begin <= t[1] and t[2] <= c]))
        begin = c
    return out


def links_of(a, b):
    return [(x[0], y[0]) for g, h in groups_of(a, b) for x in g for y in h if x[1] < y[2] and y[1] < x[2]]


def by_hand(rows):
    cut = [tokens(t) for _, t in rows]
    links = [links_of(*c) if c else [] for c in cut]
    docs = collections.Counter(p for own in links for p in set(own))
    most = collections.defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (k, _), c, own in zip(rows, cut, links, strict=True):
        groups = groups_of(*c) if c else []
        text = ";".join(",".join(str(t[0]) for t in g) + "|" + ",".join(str(t[0]) for t in h) for g, h in groups)
        sizes = [len(x) for x in c] if c else [0, 0]
        out.append((k, *sizes, len(groups), len(own), sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if c else ""))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


ODD = [
    "naïve café — 漢字漢字 🙂👩‍👩‍👧 <s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "  two  spaces   and\ttabs\n\n\nlines ", " ", "\n", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "\u0000 nul", "é combining   nbsp 　 wide", "ﬁ ligature Ａ ½",
    "don't we'll I'm 12345678901234567890", "мир труд май", "مرحبا بالعالم",
]


@pytest.fixture(scope="module")
def rows(odd, docs):
    own = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if len(r["text"] or "") < 10_000]
    own += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, ODD[0]), (2000, ODD[0])]
    return own + [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 3000]


def test_equals_bytes(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "doc_id long, text string, slice int, pairs int, n int").repartition(5)
    want = by_hand(rows)
    assert result(alignment.align(df, A, B)) == want
    assert sum(w[-1] == "" for w in want) >= 4 and any(w[3] < min(w[1], w[2]) for w in want)
    small = [r for r in rows if r[0] is None or r[0] % 5 == 0]
    monkeypatch.setattr(alignment, "PART_BYTES", 500)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 4000)
    assert result(alignment.align(spark.createDataFrame(small, "doc_id long, text string").coalesce(2), A, B)) == by_hand(small)


def test_odd_tables(spark, odd):
    assert result(alignment.align(odd.limit(0), A, B)) == []
    empty = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id long, text string")
    assert result(alignment.align(empty, A, B)) == by_hand([(1, None), (None, ""), (1, None)])
    got = result(alignment.align(odd, A, B))
    assert len(got) == odd.count() and any(r[1] > 100_000 for r in got)


def test_groups_and_links(spark):
    texts = [t for t in ODD if len(t) < 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in alignment.token_groups(df, A, B).orderBy("doc_id", "number").collect():
        got[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        cut = tokens(t)
        want = groups_of(*cut) if cut else []
        assert [(r["a"], r["b"], r["begin"], r["end"]) for r in got[i]] == [([x[0] for x in g], [x[0] for x in h], g[0][1], g[-1][2]) for g, h in want]
        assert sorted((r["a"][x["a"]], r["b"][x["b"]]) for r in got[i] for x in r["links"]) == sorted(links_of(*cut) if cut else [])
        assert [r["number"] for r in got[i]] == list(range(len(want)))


def test_query_covers_the_table(spark, docs):
    got = queries.op12_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all((r["n_a"] > 0) == bool(texts[r["doc_id"]]) for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aab \n\t'sre12漢é"))), max_size=80))
def test_ids_are_those_of_the_library(text):
    assert alignment.ranked(A)
    assert list(alignment.side(A).encode([text])[0]) == loaded()[0].encode(" " + text, add_special_tokens=False).ids


def test_ids_of_all_texts(docs):
    texts = [r["text"] or "" for r in docs.collect()] + ["a" * 50_000, " " * 3000, "<|endoftext|>x"]
    assert [list(x) for x in alignment.side(A).encode(texts)] == [e.ids for e in loaded()[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
