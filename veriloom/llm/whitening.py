"""Embedding whitening with a spectrum that is sliced by inertia counts.

Sums and the centred covariance of all vectors are summed by the tasks. The number of eigenvalues of
the covariance above a shift is the number of positive pivots of the LDL' factors of the shifted
matrix. Bisection with such counts encloses each leading eigenvalue until it is alone, or until what
is left of the interval is rounding; Rayleigh quotient iteration then converges cubically from a
vector that belongs to the interval, and counts on both sides of the result certify its number.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut

_MOST = 2**63 - 1


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``: of positive pivots of the LDL'
    factors of matrix - shift. A pivot of zero counts as a tiny negative one: the shift is moved up by
    less than rounding."""
    a = matrix - shift * np.eye(len(matrix))
    tiny, above = np.finfo(float).eps ** 2 * max(1.0, np.abs(matrix).max()), 0
    for i in range(len(a)):
        pivot = a[i, i] if abs(a[i, i]) > tiny else -tiny
        above += pivot > 0
        column = a[i + 1 :, i]
        a[i + 1 :, i + 1 :] -= np.outer(column / pivot, column)
    return above


def _without(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``v`` of length one, without its parts along orthonormal vectors."""
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
        v = v / np.linalg.norm(v)
    return v


def _quotient_iteration(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
    """An eigenpair from the interval: two steps of inverse iteration with its middle, then Rayleigh
    quotients as shifts. ``found`` are eigenvectors that the new one must be orthogonal to."""
    n, eye = len(matrix), np.eye(len(matrix))
    v, shift = _without(np.random.default_rng(7).standard_normal(n), found), (low + high) / 2
    best, least = (shift, v), np.inf
    for step in range(30):
        try:
            v = _without(np.linalg.solve(matrix - shift * eye, v), found)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit: move it by rounding
            shift += scale * np.finfo(float).eps
            continue
        if not np.isfinite(v).all():
            break
        value = float(v @ matrix @ v)
        off = float(np.linalg.norm(matrix @ v - value * v))
        if off < least:
            best, least = (value, v), off
        elif step > 3:
            break
        if step >= 1:
            shift = value
    return best


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the k largest eigenvalues of a covariance matrix by falling value;
    those that are zero up to rounding are left out, so there may be fewer.

    Equal eigenvalues cannot be told apart by counts: their interval shrinks to rounding, and their
    vectors are found one after another, each orthogonal to those before.
    """
    scale = float(np.abs(matrix).sum(1).max()) if len(matrix) else 0.0  # no eigenvalue is above it
    least = scale * len(matrix) * np.finfo(float).eps
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for number in range(1, min(k, len(matrix)) + 1):
        low, high = least, (values[-1] + 4 * least if values else scale * (1 + 1e-12))
        if inertia(matrix, low) < number:
            break
        above_low, above_high = inertia(matrix, low), inertia(matrix, high)
        while high - low > least:
            alone = above_low == number and above_high == number - 1
            if alone and high - low <= 0.01 * low:
                value, v = _quotient_iteration(matrix, low, high, vectors, scale)
                off = float(np.linalg.norm(matrix @ v - value * v))
                near = 8 * (off + least)
                if low - near <= value <= high + near and off <= 1e-9 * scale and inertia(matrix, value + near) == number - 1 and inertia(matrix, value - near) >= number:
                    break
            middle = (low + high) / 2
            if not low < middle < high:
                break
            above = inertia(matrix, middle)
            if above >= number:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        else:
            value, v = _quotient_iteration(matrix, low, high, vectors, scale)
        values.append(value)
        vectors.append(v)
    return np.array(values), np.array(vectors).reshape(len(vectors), len(matrix))


def to_integers(vector: Column, scale: int = 1024, offset: int = 100_000) -> Column:
    """floor(scale * c) + offset of every entry; null for vectors that are null, empty or hold null,
    NaN or infinite entries."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sums by ``at`` of rows (at, row: array of ``width`` doubles), each ``at`` by the task that it is
    dealt to; a matrix of as many rows as there are values of ``at``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column("at").to_pylist(), batch.column("row").flatten().to_numpy().reshape(-1, width)):
                total[at] = total[at] + row if at in total else row
        for at, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], ["at", "row"])

    rows = sorted(map(tuple, parts.repartition("at").mapInArrow(add, "at int, row array<double>").collect()))
    return np.array([row for _, row in rows]).reshape(-1, width)


def _gram(df: DataFrame, column: str, width: int, centre: np.ndarray) -> np.ndarray:
    """Sum over all rows of the products of (value - centre) with itself."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(column).flatten().to_numpy().reshape(-1, width) - centre
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["at", "row"])

    some = df.select(column).coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    return summed(some.mapInArrow(products, "at int, row array<double>"), width)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the entries of (n * x - S)^2, exact; None beyond 64 bits."""
    if n * float(np.abs(x).max(initial=0)) < 2**62 and float(np.abs(sums).max(initial=0)) < 2**62:
        off = n * x - sums
        if x.shape[1] * float(np.abs(off).max(initial=0)) ** 2 < 2**62:
            return (off * off).sum(1).tolist()
    wide = n * x.astype(object) - sums.astype(object)
    return [s if s <= _MOST else None for s in (wide * wide).sum(1).tolist()]


def whiten(vectors: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``vectors``
    (vec_id, embedding) and each of the k leading components of their covariance.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. Rows that repeat
    count as often; a null vec_id stays null. Vectors of another length than most are whitened among
    their own kind. Components whose variance is zero up to rounding are left out, so that vectors
    that are all alike, or a single one, give no rows, and an empty table gives none. A deviation
    beyond 64 bits is null. Extra columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    data = cut(vectors.select("vec_id", to_integers(F.col("embedding")).alias("x")).where("x is not null"))
    out = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for (dims,) in data.select(F.size("x")).distinct().collect() if k > 0 else ():  # the lengths of vectors: one, as a rule
        out = out.unionByName(_whiten(data.where(F.size("x") == dims), kind, dims, k))
    return out


def _whiten(data: DataFrame, kind: str, dims: int, k: int) -> DataFrame:
    spark = data.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            x = _rows(batch, dims)
            n += len(x)
            # sums of the upper and of the lower halves cannot overflow
            total += (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], ["n", "sums"])

    parts = data.select("x").coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(add, "n long, sums array<string>").collect()
    n = sum(p.n for p in parts)
    sums = sum((np.array([int(s) for s in p.sums], dtype=object) for p in parts), np.zeros(dims, dtype=object))
    mean = np.array([float(s / n) for s in sums])
    covariance = _gram(data, "x", dims, mean) / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading(covariance, k)
    kept = len(values)
    directions = components.T / np.sqrt(values)
    share = values / np.trace(covariance) if kept else values
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([float((s % n) / n) for s in sums])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = sums.astype(np.int64) if all(abs(s) <= _MOST for s in sums) else sums
        for batch in batches:
            x = _rows(batch, dims)
            w = ((x - whole).astype(float) - rest) @ directions
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_deviations(x, n, exact), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    projected = cut(data.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>")) if kept else data.where("false").select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
    error = 0.0
    if kept:
        average = np.array([projected.agg(*(F.avg(F.col("w")[i]) for i in range(kept))).first()])[0].astype(float)
        error = float(np.abs(_gram(projected, "w", kept, average) / n - np.eye(kept)).max())
    rows = projected.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.lit([float(s) for s in share] or [0.0]), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
