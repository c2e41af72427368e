"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries become whole numbers, so sums and the scatter of numbers centred near their mean are exact whatever
the order in which tasks end.  Only matrices as wide as the vectors come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0**53
COMPONENTS = 32
ROWS = 4096


def usable(table: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds neither nulls nor non-finite entries and has the usual length (longer on a tie)."""
    v = F.col(vector)
    sound = F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False))
    rows = table.where(v.isNotNull() & sound)
    usual = rows.groupBy(F.size(vector).alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return rows.where(F.size(vector) == (usual["k"] if usual else 0))


def whole(values: np.ndarray) -> np.ndarray:
    """x less the shift: floor(64 c) as whole numbers; products beyond 2^53 stay at that bound."""
    return np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            flat = part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
            yield part, whole(flat.astype(np.float64).reshape(part.num_rows, -1))


def _sums_of(batches: Iterator[pa.RecordBatch], column: str, centre: list[int] | None) -> Iterator[pa.RecordBatch]:
    """One row per cell and task: sums of entries, or of products of entries less ``centre``, as exact decimals."""
    n, total = 0, None
    for part, z in _slices(batches, column):
        n += len(z)
        if centre is not None:
            z = z - np.array(centre, dtype=np.int64)
            small = int(np.abs(z).max(initial=0)) ** 2 * len(z) < 2**62
            cells = z.T @ z if small else (lambda o: o.T @ o)(z.astype(object))
        else:
            cells = z.sum(axis=0) if int(np.abs(z).max(initial=0)) * len(z) < 2**62 else z.astype(object).sum(axis=0)
        total = cells.astype(object) if total is None else total + cells
    if total is None:
        return
    if centre is None:
        place, values = [(i, -1) for i in range(len(total))], list(total)
    else:
        place = [(i, j) for i in range(len(total)) for j in range(i, len(total))]
        values = [total[i, j] for i, j in place]
    place, values = [*place, (-1, -1)], [*values, n]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in place], pa.int32()), pa.array([p[1] for p in place], pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=["i", "j", "v"])


def _cells(rows: DataFrame, vector: str, centre: list[int] | None) -> dict[tuple[int, int], int]:
    """Sums over all rows, added up in Spark; as many rows come back as the matrix has cells."""
    parts = rows.select(vector).mapInArrow(lambda batches: _sums_of(batches, vector, centre), "i int, j int, v decimal(38,0)")
    return {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}


def pivoted_cholesky(v: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """L with one column per pivot and L L' = v, rows in the order of v; it ends where what is left is rounding."""
    left = np.diag(v).copy()
    columns: list[np.ndarray] = []
    least = tolerance * max(left.max(initial=0.0), 0.0) * len(v)
    for _ in range(len(v)):
        pivot = int(np.argmax(left))
        if left[pivot] <= least or left[pivot] <= 0:
            break
        column = v[:, pivot].copy()
        for earlier in columns:
            column -= earlier * earlier[pivot]
        column /= np.sqrt(left[pivot])
        columns.append(column)
        left = left - column**2
        left[pivot] = 0.0
    return np.column_stack(columns) if columns else np.zeros((len(v), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, components as columns)`` of ``factor factor'``, falling.

    Pairs of columns are rotated until all are at right angles; squared column norms are then the eigenvalues.
    """
    a = factor.copy()
    width = a.shape[1]
    for _ in range(sweeps):
        turned = False
        for p in range(width - 1):
            for q in range(p + 1, width):
                x, y = a[:, p], a[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= 1e-15 * np.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    norms = np.sqrt((a**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


def fit(rows: DataFrame, vector: str) -> dict | None:
    """n, per-dimension sums of z = floor(64 c), eigenvalues and components; None where nothing varies."""
    first = _cells(rows, vector, None)
    n = first.get((-1, -1), 0)
    width = len(first) - 1
    if n == 0 or width < 1:
        return None
    sums = [first[(i, -1)] for i in range(width)]
    centre = [round(Fraction(s, n)) for s in sums]
    cells = _cells(rows, vector, centre)
    off = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            v[i, j] = v[j, i] = float(Fraction(n * cells[(i, j)] - off[i] * off[j], n * n))
    values, components = one_sided_jacobi(pivoted_cholesky(v))
    return {"n": n, "sums": sums, "values": values, "components": components, "trace": float(np.trace(v))}


def _project(batches: Iterator[pa.RecordBatch], vector: str, n: int, sums: list[int], basis: np.ndarray, key: str | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, z in _slices(batches, vector):
        safe = n * (int(np.abs(z).max(initial=0)) + 1) + max(map(abs, sums)) < 2**62
        far = z * n - np.array(sums, dtype=np.int64) if safe else z.astype(object) * n - np.array(sums, dtype=object)
        yield part, far, (far.astype(np.float64) / n) @ basis


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: ``key, n, deviation, whitened array<double>, explained array<double>, identity_error``.

    Null vectors, those with null or non-finite entries and those of an unusual length are dropped; repeated rows and
    equal keys each count.  Directions in which nothing varies are left out, so a table of equal vectors, of one
    vector or of none gives no row.  A deviation beyond the range of a long stays at its end.  Other columns play no part.
    """
    rows = usable(table.select(F.col(key).alias(key), F.col(vector).alias(vector)), vector)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    model = fit(rows, vector)
    if model is None or not len(model["values"]):
        return table.sparkSession.createDataFrame([], schema)
    n, sums = model["n"], model["sums"]
    values = model["values"][:components]
    basis = model["components"][:, :components] / np.sqrt(values)
    explained = (values / model["trace"]).tolist()
    width = len(values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for _, _, w in _project(batches, vector, n, sums, basis, None):
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        cells = [(i, j) for i in range(width) for j in range(width + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    found = rows.select(vector).mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    spread = np.zeros((width, width + 1))
    for r in found:
        spread[r["i"], r["j"]] = r["v"] / n
    mean = spread[:, width]
    error = float(np.abs(spread[:, :width] - np.outer(mean, mean) - np.eye(width)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, far, w in _project(batches, vector, n, sums, basis, key):
            top = int(np.abs(far).max(initial=0))
            if top**2 * far.shape[1] < 2**62:
                deviation = (far * far).sum(axis=1)
            else:
                deviation = [min(sum(int(x) ** 2 for x in row), 2**63 - 1) for row in far]
            offsets = pa.array(np.arange(len(w) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(w).ravel()))], names=[key, "deviation", "whitened"])

    done = rows.select(key, vector).mapInArrow(out, f"{key} {kind}, deviation long, whitened array<double>")
    return done.select(key, F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(e) for e in explained]).alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    flat = whitened.select(key, "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("_at", "whitened"))
    return flat.select(key, (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("_at")).alias("explained"), "identity_error")
