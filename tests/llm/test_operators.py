"""Each operator against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import json
import math
import os
import random
import re
import sys

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnledger.llm import backoff, bpe, chunks, components, html, merkle, minhash, mixing, outliers, queries, secrets, token_cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def table(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect()]


def data(request, name):
    return request.getfixturevalue(name)


INPUTS = pytest.mark.parametrize("name", ["odd", "docs", "none"])


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return out


@INPUTS
def test_mixing(request, name):
    df = data(request, name)
    rows = table(df)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    got = mixing.taken_words(df).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _, _ in rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    copies = collections.Counter((i, t, s) for i, t, _, s in rows)
    for i, t, _, s in rows:
        largest[s] = max(largest[s], len(WORD.findall(t or "")) * copies[(i, t, s)])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken_words(df).collect()), key=repr)


def test_mix_keeps_columns_and_copies(odd):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["times"] for r in mixing.taken_words(odd).collect())


def test_lower_budgets_are_nested(docs):
    ids = lambda w: {r["doc_id"] for r in mixing.taken_words(docs, weights=w).where("times > 0").collect()}
    low, high = ids((1, 9)), ids((3, 7))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    order = sorted(set(source.values()))
    assert {i for i in low if order.index(source[i]) % 2 == 0} <= high


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


@INPUTS
def test_statistics(request, name):
    df = data(request, name)
    got = outliers.judge(df).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(repr((r["doc_id"], *(r[c] for c in columns))) for r in got) == sorted(repr((i, *statistics(t))) for i, t, _, _ in table(df))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] is not None


def test_outliers_go_and_clean_stay(spark):
    rng = random.Random(5)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    words = lambda: ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(80, 300))]
    clean = [(i, " ".join(words()), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in words()), "en", "s") for i in range(40)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in outliers.judge(df).where("kept").collect()}
    assert len(kept & set(range(400))) >= 398 and not kept & set(range(1000, 1040))
    assert {r["doc_id"] for r in outliers.kept_documents(df).collect()} == kept


def at_rank(values, share):
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def verdicts(rows):
    """(distance, kept) of rows (id, text, lang, source) by plain loops and numpy: the same estimates from exact quantiles."""
    stats = [statistics(t) for _, t, _, _ in rows]
    passes = [n >= 50 and not 100 * rep > 50 * n for n, _, _, _, rep in stats]
    x = [(math.sqrt(sym / c), math.sqrt(dup / n), rep / n, math.log(c / n)) if ok else None for (n, c, sym, dup, rep), ok in zip(stats, passes)]
    groups = collections.defaultdict(list)
    for (_, _, lang, source), v in zip(rows, x):
        if v:
            groups[(lang, source)].append(v)
            groups["all"].append(v)
    floor = np.diag([f * f for f in outliers.FLOORS.values()])
    far = lambda v, m, s: np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(s), v - m)
    raw = {}
    for g, v in groups.items():
        v = np.array(v)
        m = np.array([at_rank(c, 0.5) for c in v.T])
        s = np.diag([(at_rank(np.abs(c - a), 0.5) * 1.4826) ** 2 for c, a in zip(v.T, m)]) + floor
        for _ in range(outliers.STEPS):
            d = far(v, m, s)
            kept = v[d <= at_rank(d, outliers.KEPT_SHARE) + 1e-12]
            m, s = kept.mean(axis=0), np.cov(kept.T, bias=True) + floor
        raw[g] = len(kept), m, s
    fits = {}
    for g, (n, m, s) in raw.items():
        w = n / (n + outliers.PRIOR_ROWS)
        m, s = w * m + (1 - w) * raw["all"][1], w * s + (1 - w) * raw["all"][2]
        fits[g] = m, s, max(1.0, at_rank(far(np.array(groups[g]), m, s), 0.5) / outliers.CHI_MEDIAN)
    out = []
    for (_, _, lang, source), v in zip(rows, x):
        d = None
        if v:
            m, s, scale = fits[(lang, source)]
            d = float(far(np.array([v]), m, s)[0] / scale)
        out.append((d, d is not None and d <= outliers.CUTOFF))
    return out


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_verdicts_equal_brute_force(request, name):
    """Groups of one row and of many: all are judged by one rule."""
    df = data(request, name)
    rows = table(df)
    want = sorted(repr((i, None if d is None else round(d, 5), k)) for (i, _, _, _), (d, k) in zip(rows, verdicts(rows)))
    assert sorted(repr((r["doc_id"], None if r["distance"] is None else round(r["distance"], 5), r["kept"])) for r in outliers.judge(df).collect()) == want


def test_inverse_factor(spark):
    a = np.random.Generator(np.random.PCG64(1)).normal(size=(outliers.P, 9))
    c = a @ a.T
    row = {f"s_{i}{j}": float(c[i, j]) for i in range(outliers.P) for j in range(i + 1)}
    got = outliers.inverse_factor(spark.createDataFrame([row])).first()
    k = np.array([[got[f"k_{i}{j}"] if j <= i else 0.0 for j in range(outliers.P)] for i in range(outliers.P)])
    assert np.allclose(k.T @ k, np.linalg.inv(c)) and math.isclose(got["log_det"], math.log(np.linalg.det(c)))


@INPUTS
def test_token_counts(request, name, tmp_path):
    df, model = data(request, name), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(repr((i, len((t or "").encode()), len(model.encode(t or "")))) for i, t, _, _ in table(df))
    for _ in range(2):  # the second run finds everything in the cache
        got = token_cache.count_tokens(df, PIECES, str(tmp_path / "cache"))
        assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got.collect()) == want


def test_cache_encodes_only_distinct_misses(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    token_cache.count_tokens(odd.where("doc_id < 6"), PIECES, cache).count()
    first = spark.read.parquet(cache).count()
    token_cache.count_tokens(odd, PIECES, cache).count()
    stored = spark.read.parquet(cache)
    assert first < stored.count() == stored.select("content_digest").distinct().count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_counts_of_odd_strings():
    counter, rng = token_cache.PieceCounter(PIECES), random.Random(2)
    parts = [*"aab   \n\t'srel123é漢\x1c\x85🙂.,!▁<>/\0", "<s>", "</s>", "<unk>", "▁the", "  ", "<0x41>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    assert counter.apart and counter.count(texts) == [len(x) for x in counter.model.encode(texts)]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize("width, name", [(2, "odd"), (2, "docs"), (5, "docs"), (2, "none")])
def test_near_duplicates(request, name, width):
    df = data(request, name)
    rows = table(df)
    sets = [shingles(t, width) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for n, r in enumerate(rows):
        if r[0] is not None:
            ids[find(n)].append(r[0])
    want = []
    for n, r in enumerate(rows):
        component = min(ids[find(n)], default=None) if sets[n] else r[0]
        want.append(repr((r[0], len(sets[n]), component, r[0] == component)))
    got = minhash.near_duplicates(df, width).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == sorted(want)


def test_chained_and_crowded_buckets(spark):
    """Chains of links, and a crowd of texts that share much with each other but are not linked."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    chain = [base[i * 5 : i * 5 + 60] for i in range(8)]
    crowd = [[w if rng.random() > 0.13 else f"x{n}_{i}" for i, w in enumerate(base)] for n in range(60)]
    rows = [(n, " ".join(w), "en", "s") for n, w in enumerate(chain + crowd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sets = [shingles(t, 1) for _, t, _, _ in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 1).collect()}
    assert got == {n: find(n) for n in range(len(rows))}


def test_linked_pairs_inside_a_family(spark):
    """Pairs with one word of 100 of their own, in a family whose template alone does not link: nearly all buckets they share are
    the family's, with a stranger as the hub."""
    template = [f"t{i}" for i in range(88)]
    rows = [(2 * k + m, " ".join([*template, f"p{k}", *(f"q{k}_{m}_{i}" for i in range(11))])) for k in range(60) for m in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 1) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 1).collect()}
    assert got == {n: find(n) for n in range(len(rows))}


def test_no_linked_pair_is_bounded_away(spark):
    """Sets at 0.8 exactly, of which few shingles fill the bins: none may fail the bound before the full sets are compared."""
    rng, rows = np.random.Generator(np.random.PCG64(12)), []
    for size in [5] * 6000 + [10] * 1000 + [100] * 200 + [2000] * 20:
        a = np.unique(minhash.mix(rng.integers(0, 1 << 63, size).astype(np.uint64)))
        b = a[np.sort(rng.permutation(size)[: size * 4 // 5])]
        x, y = (dict(zip(("n", "sketch"), (len(s), minhash.sketch(s, minhash.signature(s)).tolist()))) for s in (a, b))
        rows.append((x["n"], x["sketch"], y["n"], y["sketch"]))
    df = spark.createDataFrame(rows, "a_n long, a_sketch array<long>, b_n long, b_sketch array<long>")
    assert df.where(~minhash.likely(80)).count() == 0


def test_prefix_pairs_hold_every_linked_pair(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(24), rng.randint(1, 14))) for _ in range(160)]
    sketch = lambda s: (lambda x: minhash.sketch(x, minhash.signature(x)).tolist())(np.array(s, np.uint64))
    df = spark.createDataFrame([(n, n % 40, len(s), s, sketch(s)) for n, s in enumerate(sets)], "node long, root long, n long, shingles array<long>, sketch array<long>")
    got = {(r["a"], r["b"]) for r in minhash.prefix_pairs(df, 80).collect()}
    block, minhash.BLOCK = minhash.BLOCK, 7  # any size of block gives the same
    assert {(r["a"], r["b"]) for r in minhash.prefix_pairs(df, 80).collect()} == got
    minhash.BLOCK = block
    linked = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if a % 40 != b % 40 and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len({*sets[a], *sets[b]})}
    assert linked and linked <= got


def test_one_document_of_each_group_stays(odd):
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, None, 6, 7, 8, None, 9]))


def test_signatures_agree_as_often_as_sets():
    rng = np.random.Generator(np.random.PCG64(9))
    for size in (3, 40, 900):
        agree = []
        for _ in range(30):
            pool = minhash.mix(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64))
            a, b = np.unique(pool[: int(size * 1.5)]), np.unique(pool[size // 2 :])
            want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean() - want)
        assert abs(np.mean(agree)) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 100), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[60] == 50


def tree(text):
    """The fingerprint of a text by plain loops, and its distinct pieces."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sections, leaves = [], set()
    for section in (text or "").split("\n\n"):
        paragraphs = []
        for p in section.split("\n"):
            pieces = [md5(m.group()) for m in re.finditer(r" *(?:[^ ]+ *){1,8}| +", p)]
            leaves |= {x[:6] for x in pieces}
            paragraphs.append((md5("".join(pieces)), "".join("." + x[:6] for x in pieces)))
        sections.append((md5("".join(d for d, _ in paragraphs)), ",".join(d[:8] + of for d, of in paragraphs)))
    root = hashlib.sha256("".join(d for d, _ in sections).encode()).hexdigest()[:32]
    return root + "/" + ";".join(f"{d[:8]}({of})" for d, of in sections), leaves


def alike(a, b):
    (f, x), (g, y) = tree(a), tree(b)
    return 1.0 if f == g else len(x & y) / max(len(x), len(y), 1)


def fingerprint_rows(rows):
    """The rows that fingerprints gives for (doc_id, text), in the order of ids, then of the texts' digests."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append(repr((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), tree(t)[0], tree(edited)[0], round(alike(t, edited), 9), round(alike(t, after), 9))))
    return sorted(out)


def test_fingerprints_equal_brute_force(spark, odd, docs, none):
    crowd = [(n % 3 or None, f"one hot text\n\n{n % 5} of it") for n in range(90)] + [(7, "the same row")] * 60
    hot = spark.createDataFrame(crowd, "doc_id long, text string")
    one = spark.createDataFrame([(5, "alone by itself")], "doc_id long, text string")
    for df in (odd, docs, none, hot, one):
        got = merkle.fingerprints(df).collect()
        want = fingerprint_rows([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted(repr((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got) == want


def test_tree_tells_texts_and_places(spark):
    texts = ["a\nb\n\nc", "a\nb\n\nc", "a\n\nb\nc", "a b\n\nc", "a\nb\n\nd", "", "\n", "\n\n"]
    got = [r[0] for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(merkle.fingerprint(F.col("t"))).collect()]
    assert got[0] == got[1] and len(set(got)) == len(texts) - 1
    first, last = (g.split("/")[1].split(";") for g in (got[0], got[4]))
    assert first[0] == last[0] and first[1] != last[1]


@INPUTS
def test_backoff(request, name):
    df = data(request, name)
    rows = table(df)
    words = [(t or "").encode().lower().split() for _, t, _, _ in rows]
    count, n = collections.Counter(), sum(map(len, words))
    for w in words:
        count.update(w)
        count.update(zip(w, w[1:]))

    def score(w):
        own = collections.Counter(w)
        own.update(zip(w, w[1:]))
        one = lambda x: (count[x] - own[x] or 0.4) / max(1, n - len(w))
        out = math.log10(one(w[0]))
        for p in zip(w, w[1:]):
            seen = count[p] - own[p]
            out += math.log10(seen / max(1, count[p[0]] - own[p[0]]) if seen > 0 else 0.4 * one(p[1]))
        return round(out, 4)

    want = sorted(repr((r[0], len(w), score(w) if w else None)) for r, w in zip(rows, words))
    got = backoff.score(df).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], None if r["log_score"] is None else round(r["log_score"], 4))) for r in got) == want


def spans_of(text):
    text, out = text or "", []
    kinds = [
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ]
    for k, (name, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    return [x[2] for x in sorted(out)]


@INPUTS
def test_base_spans(request, name):
    df = data(request, name)
    got = secrets.find_secrets(df).withColumns({"base": secrets.span_names(F.col("base")), "spans": secrets.span_names(F.col("spans"))}).collect()
    assert sorted(repr((r["doc_id"], r["base"])) for r in got) == sorted(repr((i, ",".join(spans_of(t)))) for i, t, _, _ in table(df))
    for r in got:
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_owners_tell_examples_from_live(spark):
    copied, own = "ghp_" + "Example1234567890abcdEFGH", "ghp_" + "q8Zk2Lw9Xv4Tn7Rb1Yc6Md3P"
    rows = [(n, f"see {copied} in the docs", f"s{n}") for n in range(6)] + [(9, f"deploy with {own} today", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).withColumn("spans", secrets.span_names(F.col("spans"))).collect()}
    assert got[9] == f"prefixed:12:{12 + len(own)}" and all(got[n] == "" for n in range(6))


def test_copies_inside_one_source_are_examples_and_long_values_count(spark):
    copied, own = "ghp_" + "Example1234567890abcdEFGH", "q8Zk2Lw9Xv4Tn7Rb1Yc6Md3P" * 9
    rows = [(n, f"see {copied} in the docs", "s") for n in range(20)] + [(50, f'key "{own}"', "s"), (51, f"https://{'u' * 70}:{own}x@host/", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_example"]) for r in secrets.find_secrets(df).withColumn("spans", secrets.span_names(F.col("spans"))).collect()}
    assert all(got[n] == ("", 0, 1) for n in range(20))
    assert got[50] == (f"quoted:5:{5 + len(own)}", 1, 0) and got[51] == (f"url_login:79:{80 + len(own)}", 1, 0)


def owned_spans(rows):
    """(spans, n_live, n_example) of rows (id, text, source) by counting owners and repositories one after another."""
    found = [(base := secrets.base_spans(t or ""), secrets.further_spans(t or "", base)) for _, t, _ in rows]
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for n, ((i, _, source), (base, more)) in enumerate(zip(rows, found)):
        for *_, v in [*base, *more]:
            owners[v].add(source)
            repositories[v].add(n if i is None else ("id", i))
    example = lambda v: len(owners[v]) >= 4 or len(repositories[v]) >= 8
    live = lambda v: not example(v) and secrets.entropy(v) >= 2.8
    out = []
    for base, more in found:
        spans = sorted([(s, k, e) for s, k, e, _ in base] + [(s, k, e) for s, k, e, v in more if live(v)])
        values = [v for *_, v in [*base, *more]]
        out.append((",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans), sum(map(live, values)), sum(map(example, values))))
    return out


def test_added_spans_equal_brute_force(spark, odd, docs):
    rng = random.Random(7)
    value = lambda n: "ghp_" + "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789", k=n))
    pool = [value(20) for _ in range(12)] + [f'"{value(30)}"' for _ in range(4)] + ["https://u:" + value(9) + "@h/", "token=aaaaaaaaaaaaaaaaaaaa", "Bearer " + value(25)]
    crowd = [(rng.choice([n, n, n % 9, None]), " and ".join(rng.choices(pool, k=rng.randint(0, 3))), rng.choice(["a", "b", "c", "d", "e", None])) for n in range(60)]
    made = spark.createDataFrame(crowd, "doc_id long, text string, source string")
    for df in (made, odd, docs):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
        got = secrets.find_secrets(df).withColumn("spans", secrets.span_names(F.col("spans"))).collect()
        want = sorted(repr((i, *o)) for (i, _, _), o in zip(rows, owned_spans(rows)))
        assert sorted(repr((r["doc_id"], r["spans"], r["n_live"], r["n_example"])) for r in got) == want
    assert secrets.redacted(made.limit(0)).count() == 0


def test_intermediate_tables_are_cleaned(spark):
    from cairnledger.llm import common

    assert common.as_table(spark.range(3)).count() == 3
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.own_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(folder)
    common.clean(spark)
    assert not files.exists(folder)


def test_redaction(odd):
    clean = secrets.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    text = clean.where("doc_id = 8").first()
    assert text["text"] == "[secret] and [secret]".replace("[secret] and", '[secret]" and') and text["n_chars"] == len(text["text"])
    assert clean.where("doc_id = 7").first()["text"] == odd.where("doc_id = 7").first()["text"]


@INPUTS
def test_bpe(request, name):
    df, tok = data(request, name), Tokenizer.from_file(BYTES)
    encoded = bpe.encode(df, BYTES, keep=["doc_id"])
    got = bpe.decode(encoded, BYTES).collect()
    assert sorted(map(repr, bpe.encode(df, BYTES, keep=["doc_id"], decoded_col="decoded").collect())) == sorted(map(repr, got))
    want = []
    for i, t, _, _ in table(df):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append(repr((i, ids, tok.decode(ids, skip_special_tokens=False))))
    assert sorted(repr((r["doc_id"], r["ids"], r["decoded"])) for r in got) == sorted(want)


def test_files_with_other_settings_are_refused(tmp_path):
    for path, value in ((("normalizer",), {"type": "NFC"}), (("pre_tokenizer", "add_prefix_space"), True), (("model", "ignore_merges"), True), (("added_tokens", 0, "lstrip"), True), (("model", "dropout"), 0.1)):
        with open(BYTES, encoding="utf-8") as f:
            spec = json.load(f)
        at = spec
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
        (tmp_path / "other.json").write_text(json.dumps(spec))
        with pytest.raises(ValueError):
            bpe.Encoder(str(tmp_path / "other.json"))


def test_bpe_of_odd_strings():
    tok, enc, rng = Tokenizer.from_file(BYTES), bpe.Encoder(BYTES), random.Random(1)
    parts = [*"aaab   \n\t'srel123é漢\x1c\x85🙂.,!", "<|endoftext|>", "'ll", "'s", "  ", "aaaaaa"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    flat, lengths = enc.texts(texts)
    got = np.split(flat, np.cumsum(lengths)[:-1])
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def plain(text):
    return (text or "").encode().lower().split()


def runs_of(rows, n):
    """The rows that hold each run of n words."""
    held = collections.defaultdict(set)
    for r, w in enumerate(rows):
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(r)
    return held


def covered_words(rows, n, others):
    """Words (row, place) that lie in a run of n words which a row of others(r, holders) holds too."""
    held = runs_of(rows, n)
    return {(r, i + k) for r, w in enumerate(rows) for i in range(len(w) - n + 1) if others(r, held[tuple(w[i : i + n])]) for k in range(n)}


@pytest.fixture(scope="module")
def shared(spark):
    """Texts of long, short and single-letter words with passages of 50 words and more that others hold, moved, cut and inserted into."""
    rng = random.Random(8)
    kinds = ["abcdefghijklmnop", "ab", "xyz"]
    words = lambda n, k: ["".join(rng.choices(kinds[k], k=rng.randint(2, 9) if k == 0 else rng.randint(1, 2 * k))) for _ in range(n)]
    rows = [words(rng.randint(0, 200), 0) for _ in range(20)]
    for k in range(3):
        for n in (50, 51, 55, 90, 400):
            passage = words(n, k)
            for _ in range(rng.randint(2, 4)):
                rows.append([*words(rng.randint(0, 90), k), *passage, *words(rng.randint(0, 90), k)])
            at = rng.randint(0, n)
            rows.append([*passage[:at], "INSERTED", *passage[at:]])
    rows += [["same"] * 70, ["same"] * 90, rows[3], rows[3]]
    texts = [rng.choice([" ", "\n", "  "]).join(r).title() for r in rows]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), [plain(t) for t in texts]


def test_repeated_passages_equal_brute_force(shared):
    df, rows = shared
    found = {(r["doc_id"], i) for r in chunks.repeated_passages(df).collect() for i in range(r["start_word"], r["end_word"])}
    assert found <= covered_words(rows, chunks.LEAST_WORDS, lambda r, held: len(held) > 1)
    for run, held in runs_of(rows, chunks.SURE_WORDS).items():
        for r in held if len(held) > 1 else ():
            for i in range(len(rows[r]) - len(run) + 1):
                if tuple(rows[r][i : i + len(run)]) == run:  # all but its edges
                    assert {(r, k) for k in range(i + 12, i + len(run) - 15)} <= found


def test_later_repeats_are_taken_out(shared):
    df, rows = shared
    left = [plain(r["text"]) for r in chunks.deduplicated(df).orderBy("doc_id").collect()]
    gone = covered_words(rows, chunks.LEAST_WORDS, lambda r, held: min(held) < r)
    for r, (before, after) in enumerate(zip(rows, left)):
        rest = iter(before)
        assert all(w in rest for w in after)  # what stays is in order
        assert len(before) - len(after) <= sum((r, i) in gone for i in range(len(before)))
    long = runs_of(rows, 100)
    assert not any(len({r for r, w in enumerate(left) if run in zip(*(w[k:] for k in range(100)))}) > 1 for run, held in long.items() if len(held) > 1)


def test_passages_of_odd_rows(spark, odd, none):
    assert chunks.repeated_passages(none).count() == 0 and chunks.deduplicated(none).count() == 0
    assert {r["doc_id"] for r in chunks.repeated_passages(odd).collect()} == {1, 2}
    clean = chunks.deduplicated(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.where("text IS NOT NULL").collect())
    kept = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] in (3, 4, 7, 9)}
    assert kept == {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] in (3, 4, 7, 9)}


def test_gear_looks_back_only_so_far():
    a, b = (np.frombuffer(x + b"the same tail of more than eight bytes", np.uint8) for x in (b"one", b"another head"))
    bits = np.uint32((1 << chunks.LOOK_BACK) - 1)
    assert (chunks.gear(a)[-20:] == chunks.gear(b)[-20:]).all() and bits


def test_no_chunk_is_longer_than_the_window():
    rng = np.random.Generator(np.random.PCG64(3))
    for h in (rng.integers(0, 1 << 32, 500).astype(np.uint32), rng.integers(0, 3, 500).astype(np.uint32), np.zeros(60, np.uint32)):
        at = chunks.cuts(h)
        assert np.diff(at, prepend=-1).max() <= chunks.WINDOW and len(h) - 1 - at[-1] < chunks.WINDOW


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain words only", ""),
        ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Short.</p><p>a &amp; b<br>c</p></article><footer>&copy; x</footer>", "Title\nShort.\na & b\nc"),
        ("<article><p>one<script>var x='</p>'</script> two</p><aside>see also</aside><div class='comments'><p>Great post, thanks for it!</p></div></article>", "one two"),
        ("<article><p>never   closed\n text &lt;b&gt; &#233;<form><input>mail</form>", "never closed text <b> é"),
        ("<div class=cookie-notice><p>We use cookies to make this site better for all of you, and to see how it is used by you.</p></div><main><p>Body.</p></main>", "Body."),
        ("<article><style>p{}</style><!-- <p>no</p> --><p>yes</p></article><article class=comment><p>no</p></article>", "yes"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LINE = "The water of the river gets to the sea, and it is told for all who want to know of it, that this was so in the days of old."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='has-sidebar'><article><p>Body.</p></article></div>", "Body."), ("<div class='site-widget'><article><p>Body.</p></article></div>", "Body."),
        ("<form><nav>Menu</nav><main><p>Body.</p></main></form>", "Body."), ("<article class='no-comments'><p>Body.</p></article>", "Body."),
        ("<div id=legal><div role=main><p>Body.</p></div></div>", "Body."), (f"<form><p>{LINE * 2}</p></form>", LINE * 2),
        ("<div hidden><article><p>No.</p></article></div><article><p>Body.</p></article>", "Body."),
        ("<article><p>One.</p><button>Go<p>Two.</p><svg><path d=x><p>Three.</p><button>x</button></article>", "One.\nTwo.\nThree."),
        ("<article><p>One.</p><aside><article><p>Teaser.</p></article></aside><script>var x = '<p>no</p>'", "One."),
    ],
)
def test_wrappers_and_unclosed_elements_lose_no_article(page, text):
    assert html.main_text(page) == text


def test_open_blocks_follow_their_neighbours():
    assert html.second_pass([None, True, None, None, False, None]) == [True, True, True, False, False, False]
    assert html.second_pass([None, None]) == [False, False]
    assert html.second_pass([True, None, False]) == [True, True, False]


def test_second_pass_equals_brute_force():
    rng = random.Random(6)
    for _ in range(500):
        labels = [rng.choice([None, None, True, False]) for _ in range(rng.randint(0, 9))]
        heads = [rng.random() < 0.3 for _ in labels]
        want = []
        for i, label in enumerate(labels):
            near = [((j - i if j > i else (i - j) * (2 if heads[i] else 1)), not x) for j, x in enumerate(labels) if x is not None and None not in (x,)]
            between = lambda j: any(labels[k] is not None for k in range(min(i, j) + 1, max(i, j)))
            near = [(d, dropped) for (d, dropped), j in zip(near, [j for j, x in enumerate(labels) if x is not None]) if not between(j)]
            want.append(label if label is not None else bool(near) and not min(near)[1])
        assert html.second_pass(labels, heads) == want


def test_blocks_are_judged_by_their_text(pages):
    """The same text where the article is no article, and where there is more than one."""
    rows = [r["html"] for r in pages.collect()]
    same = sum(html.main_text(p.replace("article>", "div>")) == html.main_text(p) for p in rows)
    assert same >= 0.99 * len(rows)
    first = f"<article><p>{LINE}</p></article>"
    assert all(html.main_text(p.replace("<article>", first + "<article>")) == f"{LINE}\n{html.main_text(p)}" for p in rows)
    for tag in ("button", "svg", "textarea"):
        assert all(html.main_text(p.replace("</article>", f"<p>{LINE}</p><{tag}><p>{LINE}</p></article>")) == f"{html.main_text(p)}\n{LINE}\n{LINE}" for p in rows[:20])
    links = "<div><a href=1>All the news of the day and of the week</a></div>"
    assert all(html.main_text(p.replace("</article>", f"{links}</article>{links}")) == html.main_text(p) for p in rows)


def test_long_and_deep_pages():
    assert html.main_text("<div>" * 20_000 + f"<p>{LINE * 2}</p>") == LINE * 2
    assert html.main_text(f"<article><p>{(LINE + ' ') * 20_000}</p></article>") == " ".join([LINE] * 20_000)


def test_pages_with_clashing_columns(pages):
    clash = pages.withColumns({c: F.lit(7) for c in ("text", "n_chars", "html_col", "__html")})
    got, want = (sorted(map(tuple, html.extract(p).collect())) for p in (clash, pages))
    assert got == want


def test_page_without_regions():
    body = "The article is about the way that the water of a river gets to the sea, and it is told for all who want to know of it. " * 2
    page = f"<div><a href=1>Home</a> <a href=2>News</a> <a href=3>All</a></div><p>{body}</p><p>So it goes.</p><p>{body}</p><div><a href=4>More of this</a></div>"
    assert html.main_text(page) == f"{body.strip()}\nSo it goes.\n{body.strip()}"


def test_pages(spark, pages):
    got = html.extract(pages).collect()
    want = {}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    empty = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in html.extract(empty).collect()] == [("", 0)] * 2
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from compare import connection, rows

    sf = "/root/testdata/sf0.001"
    got, want = queries.QUERIES[name](spark, sf).toPandas(), connection(sf).sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stage_names_and_queries(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 11))


def test_pipeline_over_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    for start in (odd, odd.limit(0)):
        docs = start
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if n < 4:
                assert out.columns == start.columns
            path = str(tmp_path / f"{n}-{start is odd}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.where("NOT decodes").count() == 0


def test_pipeline_stages_one_by_one(spark, docs):
    import corpus_pipeline

    quality, dedup, scan = (f for _, f in corpus_pipeline.STAGES[:3])
    kept = quality(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in outliers.judge(docs).where("kept").collect()}
    left = dedup(spark, docs, "")
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert scan(spark, docs, "").count() == docs.count()
