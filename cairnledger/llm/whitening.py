"""Whitening of embeddings by the principal components of their covariance.

Spark computes what needs all rows: the count and the exact sums of each dimension, and the covariance, centred before it is multiplied; each
task adds up its own rows and only one matrix a task is shuffled. The matrix, as large as the dimension squared whatever the number of rows, is
split on the driver by spectral divide and conquer: the polar factor of the covariance less a shift, found by QDWH iterations, gives the projector
on the space above the shift; that space and its complement are split again until each holds one component (or has one eigenvalue). Only spaces
that hold one of the wanted components are split. The components are small and go to the tasks with the function that projects the rows.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are vectors of another length than most
have (of lengths as frequent, the larger counts). A null vec_id is kept, and repeated rows count as often as they occur. An entry of the fit
beyond 2 ** 52 is taken as that. A component without variance (one row, or repeated rows only) has no scale: its whitened values are null, it
explains 0, and it is left out of identity_error. deviation is null where long can't hold it; deviation_exact has it up to 38 digits. Without
rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Beyond this doubles have no units.
MOST = 2**52
#: Rows that are multiplied at once.
ROWS_AT_ONCE = 8192
#: A component whose variance is this share of the first's, or less, is rounding.
NO_VARIANCE = 1e-13


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that can be whitened, and their dimension."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 0
    return rows.where(F.size("v") == dim), dim


def whole(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as long x, some rows at a time."""
    for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
        v = batch.column("v").slice(begin, ROWS_AT_ONCE).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        yield np.clip(np.floor(SCALE * v), -MOST, MOST).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as long where that can hold it, else as Python's integers."""
    if int(np.abs(x).max(initial=0)) * n + max(abs(int(s)) for s in sums) < 2**62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def dimension_sums(rows: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            n += batch.num_rows
            for x in whole(batch, dim):
                total += x.astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pylist([{"i": i, "n": n, "s": str(t)} for i, t in enumerate(total)], pa.schema({"i": pa.int32(), "n": pa.int64(), "s": pa.string()}))

    parts = rows.select("v").mapInArrow(add, "i int, n long, s string")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return (sums[0]["n"], np.array([int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])], object)) if sums else (0, np.zeros(dim, object))


def covariance(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Of all rows, with divisor n. A task sends one matrix, row by row; the rows of one number are added where they meet."""
    dim = len(sums)
    schema = "i int, c array<double>"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        seen = False
        for batch in batches:
            for x in whole(batch, dim):
                apart = (centred(x, n, sums) / n).astype(float)
                total += apart.T @ apart
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("i").to_pylist(), batch.column("c").flatten().to_numpy().reshape(-1, dim), strict=True):
                held[i] = held[i] + c if i in held else c.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "c"])

    added = rows.select("v").mapInArrow(multiply, schema).repartition(F.col("i")).mapInArrow(add, schema).collect()
    matrix = np.array([r["c"] for r in sorted(added, key=lambda r: r["i"])]) / n
    return (matrix + matrix.T) / 2


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations.

    `low` bounds the least singular value of the iterate from below; the weights are the best for it, and six steps or so take
    it from rounding to 1. Steps go on until the iterate rests.
    """
    size, eye = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps / size
    for _ in range(40):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2) if square < 1 else 0.0
        h = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * np.sqrt(1 + root)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        following = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        following = (following + following.T) / 2
        low = min(1.0, low * (h + b * square) / (1 + c * square))
        moved = np.linalg.norm(following - x)
        x = following
        if moved < 1e-14 * size and low > 0.9:
            break
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of a symmetric matrix above and below a shift between its eigenvalues; None if it has one eigenvalue.

    The mean of the eigenvalues has some on both sides. Where it is one of them itself, the polar factor is no reflection, and
    a shift beside it is taken.
    """
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 1e-14 * np.linalg.norm(a) * size:
        return None
    for aside in (0.0, 0.05, -0.05, 0.11, -0.11, 0.017, -0.017, 0.0037, -0.0037):
        shifted = a - (mean + aside * spread / np.sqrt(size)) * np.eye(size)
        above = (polar(shifted) + np.eye(size)) / 2
        rank = round(np.trace(above))
        if not 0 < rank < size or np.linalg.norm(above @ above - above) > 1e-10 * size:
            continue
        start = above @ np.random.default_rng(size).standard_normal((size, rank))
        for _ in range(3):  # subspace iteration with a projector: it rests after a step or two
            basis, _ = np.linalg.qr(start, mode="complete")
            upper, lower = basis[:, :rank], basis[:, rank:]
            if np.linalg.norm(lower.T @ a @ upper) <= 1e-13 * np.linalg.norm(a) * size:
                break
            start = above @ upper
        return upper, lower
    raise ArithmeticError("no shift splits the covariance")


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns. Of either sign, that with the largest
    entry positive."""
    found: list[tuple[float, np.ndarray]] = []
    open_spaces = [np.eye(len(a))]  # the space of the largest eigenvalues last
    while open_spaces and len(found) < most:
        space = open_spaces.pop()
        inside = space.T @ a @ space
        inside = (inside + inside.T) / 2
        split = halves(inside) if len(inside) > 1 else None
        if split:
            open_spaces += [space @ split[1], space @ split[0]]
        else:
            found += [(float(v @ a @ v), v) for v in space.T]
    found = sorted(found, key=lambda x: -x[0])[:most]
    vectors = np.array([v / np.linalg.norm(v) * np.sign(v[np.abs(v).argmax()]) for _, v in found]).T
    return np.array([e for e, _ in found]), vectors


def project(rows: DataFrame, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(vec_id, deviation, deviation_exact, w): the rows' whitened coordinates, null along components without variance."""
    dim = len(sums)
    scaled = values > NO_VARIANCE * max(values[0], 1)
    ways = vectors[:, scaled] / np.sqrt(values[scaled])
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for x in whole(batch, dim):
                apart = centred(x, n, sums)
                if apart.dtype != object and float(np.abs(apart).max()) ** 2 * dim >= 2**62:
                    apart = apart.astype(object)
                deviation = (apart * apart).sum(axis=1)
                coordinates = np.full((len(x), len(values)), np.nan)
                coordinates[:, scaled] = (apart / n).astype(float) @ ways
                w = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(values), pa.array(coordinates.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(begin, len(x)), pa.array([str(d) for d in deviation]), w], ["vec_id", "deviation", "w"])
                begin += len(x)

    projected = rows.mapInArrow(run, f"vec_id {kind}, deviation string, w array<double>")
    return projected.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation_exact"), "w")


def identity_error(projected: DataFrame, used: list[int]) -> float | None:
    """The largest entry by which the covariance of the whitened rows differs from the identity, over the components that are scaled."""
    if not used:
        return None
    w = {i: F.get("w", F.lit(i)) for i in used}
    means = projected.agg(*(F.avg(c).alias(f"m{i}") for i, c in w.items())).first()
    pairs = [(i, j) for i in used for j in used if i <= j]
    spread = projected.agg(*(F.avg((w[i] - means[f"m{i}"]) * (w[j] - means[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    `most` is the number of components, from that of the largest variance on."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, sums = dimension_sums(rows, dim) if dim else (0, np.zeros(0, object))
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    spread = covariance(rows, n, sums)
    values, ways = components(spread, min(most, dim))
    projected = as_table(project(rows, n, sums, values, ways))
    trace = float(np.trace(spread))
    used = [i for i, e in enumerate(values) if e > NO_VARIANCE * max(values[0], 1)]
    error = identity_error(projected, used)
    explained = F.array(*(F.lit(max(float(e), 0.0) / trace if trace > 0 else 0.0) for e in values))
    each = projected.select("vec_id", "deviation", "deviation_exact", F.posexplode("w").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )
