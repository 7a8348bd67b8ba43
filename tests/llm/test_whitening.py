"""Whitening against numpy's own eigenvectors, and the spectral division by itself."""

import math

import numpy as np
import pytest

from cairnledger.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, n int"


def by_hand(rows, most=8):
    kept = [(k, v) for k, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    apart = (x * n - sums) / n
    values, ways = np.linalg.eigh(apart.T @ apart / n)
    values, ways = values[::-1][:most], ways[:, ::-1][:, :most]
    deviation = [sum((int(a) * n - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return [k for k, _ in kept], n, deviation, apart @ ways / np.sqrt(values), values / np.trace(apart.T @ apart / n)


def check(df, rows):
    ids, n, deviation, whitened, explained = by_hand(rows)
    got = df.collect()
    assert len(got) == len(ids) * whitened.shape[1]
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for c in range(whitened.shape[1]):
        own = {(r["vec_id"], r["deviation"]): r for r in got if r["component"] == c + 1}
        want = dict(zip(zip(ids, deviation, strict=True), whitened[:, c], strict=True))
        assert set(own) == set(want)
        a, b = np.array([own[k]["whitened"] for k in want]), np.array(list(want.values()))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(abs(r["explained"] - explained[c]) < 1e-10 for r in own.values())


def test_query_equals_eigh(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, folder), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * (1, 2, 3, 4, 5)], 7) for i in range(60)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0], 7), (100, None, 7), (101, [1.0, None, 1.0, 1.0, 1.0], 7), (102, [float("nan")] * 5, 7), (103, [1.0, float("-inf"), 1.0, 1.0, 1.0], 7), (104, [], 7)]
    rows += [(105, rows[3][1], 7), (3, rows[3][1], 7)]  # repeated
    other = [(200, [1.0] * 6, 7)]  # of another length
    distinct = [r for r in rows if r[0] != 3 or r is not rows[-1]]
    df = spark.createDataFrame(rows + other, KIND).repartition(3)
    got = whitening.whiten(df).collect()
    assert len(got) == (60 + 3) * 5
    check(whitening.whiten(spark.createDataFrame(distinct + other, KIND)), distinct)


def test_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], KIND)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(i, None, 0.0, 0, None) for i in (1, 2, 3)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(5)], KIND)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(spark.createDataFrame([], KIND)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], KIND)).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(1, [3e38, 0.0], 1), (2, [-3e38, 1.0], 1), (3, [0.5, 7.0], 1)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, KIND)).where("component = 1").collect()}
    x = [[2**52 + 100_000, 100_000], [-(2**52) + 100_000, 101_024], [100_512, 107_168]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for k, r in enumerate(x, 1):
        want = sum((3 * a - s) ** 2 for a, s in zip(r, sums, strict=True))
        assert int(got[k]["deviation_exact"]) == want and got[k]["deviation"] == (want if want < 2**63 else None)


@pytest.mark.parametrize("values", [[3, 3, 2, 2, 1, 1, 0, 0], [1, 2, 3], [5], [4, 4, 4], [1e6, 1, 1e-6, 0], list(range(30)), [0, 0]])
def test_components(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.components(a, 8)
    scale = max(1, max(values))
    assert np.allclose(e, sorted(values, reverse=True)[:8], atol=1e-13 * scale, rtol=0)
    assert np.allclose(a @ v, v * e, atol=1e-12 * scale, rtol=0) and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-12)


def test_polar_is_the_orthogonal_factor():
    rng = np.random.default_rng(9)
    for size in (1, 4, 20):
        a = rng.standard_normal((size, size))
        a = a + a.T
        values, ways = np.linalg.eigh(a)
        assert np.allclose(whitening.polar(a), ways @ np.diag(np.sign(values)) @ ways.T, atol=1e-11)
