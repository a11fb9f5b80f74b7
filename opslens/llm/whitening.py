"""Whitening of embeddings: principal components of unit variance.

Statistics are of the distinct integer vectors: their number and exact sums in one pass, the scatter of the centred vectors in
a second. Each task adds up a matrix of its own and Spark adds the matrices entry by entry, so the driver sees one
number for a pair of dimensions, whatever the number of rows.

The covariance is factored by a Cholesky decomposition that takes the dimension with the largest rest of variance first and
ends when nothing but rounding is left. One-sided Jacobi rotations then make the columns of the triangular factor orthogonal:
with V = L L' and L J = U S, the squared norms of the rotated columns are the eigenvalues of V, the normalised columns its
eigenvectors. V itself is never rotated, which keeps small eigenvalues exact too. In each round of a sweep the columns meet in
disjoint pairs, as in a round-robin tournament, so a round is a few array operations.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.vectors import integer_rows, most_dims, unpacked
from opslens.session import materialize

SCALE = 256
COMPONENTS = 4
ROUNDING = 1e-15
MOST_SWEEPS = 60


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A factor L with L L' = v, a column for each pivot; triangular once the rows are in the order of the pivots."""
    rest = v.diagonal().copy()
    least = ROUNDING * len(v) * rest.max(initial=0.0)
    columns: list[np.ndarray] = []
    while len(columns) < len(v) and rest.max() > least:
        pivot = int(rest.argmax())
        column = v[:, pivot].copy()
        if columns:
            done = np.stack(columns, 1)
            column -= done @ done[pivot]
        column[rest == 0] = 0.0
        column /= np.sqrt(rest[pivot])
        column[pivot] = np.sqrt(rest[pivot])
        rest = np.maximum(rest - column**2, 0.0)
        rest[pivot] = 0.0
        columns.append(column)
    return np.stack(columns, 1) if columns else np.zeros((len(v), 0))


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor', falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    count = factor.shape[1]
    turned = np.pad(factor, ((0, 0), (0, count % 2)))
    order = np.arange(turned.shape[1])
    half = len(order) // 2
    for _ in range(MOST_SWEEPS):
        settled = True
        for _ in range(max(len(order) - 1, 0)):
            p, q = order[:half], order[half:][::-1]
            one, other = turned[:, p], turned[:, q]
            a, b, both = (one**2).sum(0), (other**2).sum(0), (one * other).sum(0)
            off = np.abs(both) > ROUNDING * np.sqrt(a * b)
            if off.any():
                settled = False
                p, q, one, other = p[off], q[off], one[:, off], other[:, off]
                slope = (b[off] - a[off]) / (2 * both[off])
                tangent = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1.0, slope))
                cosine = 1 / np.hypot(1.0, tangent)
                sine = cosine * tangent
                turned[:, p], turned[:, q] = cosine * one - sine * other, sine * one + cosine * other
            order = np.r_[order[0], order[-1], order[1:-1]]
        if settled:
            break
    turned = turned[:, :count]
    values = (turned**2).sum(0)
    falling = np.argsort(-values, kind="stable")
    values, vectors = values[falling], turned[:, falling] / np.sqrt(values[falling])
    top = np.abs(vectors).argmax(0) if count else np.zeros(0, int)
    return values, vectors * np.where(vectors[top, np.arange(count)] < 0, -1.0, 1.0)


def summed(rows: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], height: int) -> np.ndarray:
    """The sum of ``part(x)`` over all batches of vectors, a matrix of ``height`` rows: added up by task, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = part(unpacked(batch.column(0).to_pylist(), dims))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(list(total))], names=["i", "row"])

    added = rows.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    found = added.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    matrix = np.zeros((height, dims))
    matrix[found["i"].to_numpy(), found["j"].to_numpy()] = found["value"].to_numpy()
    return matrix


def exact_sums(rows: DataFrame, dims: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dims)
            wide = len(x) and int(np.abs(x).max()) * len(x) >= 1 << 63
            total = [t + int(s) for t, s in zip(total, x.astype(object if wide else np.int64).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(map(str, total), pa.string())], names=["i", "total"])

    added = rows.select("x").mapInArrow(run, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r["i"]: int(r["total"]) for r in added.collect()}
    return [totals.get(i, 0) for i in range(dims)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - sum) ** 2 of each vector, exact; null where it leaves 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * most**2 < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    found = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [f if f < 1 << 63 else None for f in found]


def whiten(
    table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one for each usable row and component.

    Entries become integers, floor(scale * entry). Rows whose vector is null or holds null, non-finite or 64-bit-exceeding
    entries are dropped; vectors shorter than the longest end in zeros. ``n`` distinct vectors are fitted, so rows that repeat
    change nothing; components come by falling variance, at most as many as there are dimensions. ``explained`` is a component's
    share of the whole variance. ``identity_error`` is measured: the largest entry by which the covariance of the whitened
    distinct vectors differs from the identity. Where the vectors do not vary in a direction, as with a single vector, its
    ``whitened`` is null, its share 0, and it takes no part in the error. Repeated rows and null ids stay; an empty
    table gives no rows.
    """
    rows = integer_rows(table.select(F.col(id_col).alias("id"), vector_col), vector_col, scale, "id")
    fit = materialize(rows.select("x").distinct(), "fit_list")
    n, dims = fit.agg(F.count("*"), most_dims(fit)).first()
    count = min(components, dims)
    sums = exact_sums(fit, dims) if n else []
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = summed(fit, dims, scatter, dims) / n if count else np.zeros((0, 0))
    values, vectors = jacobi(pivoted_cholesky(covariance))
    values, vectors = values[:count], vectors[:, :count]
    found = len(values)

    def project(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        """The products of the whitened entries and, in the last row, their sums, with zeros up to ``dims`` columns."""
        y = project(x)
        return np.pad(np.r_[y.T @ y, [y.sum(0)]], ((0, 0), (0, dims - found)))

    error = 0.0
    if found:
        seen = summed(fit, dims, moments, found + 1)[:, :found] / n
        error = float(np.abs(seen[:found] - np.outer(seen[found], seen[found]) - np.eye(found)).max())
    trace = float(np.trace(covariance))
    shares = [float(v) / trace for v in values] + [0.0] * (count - found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1).to_pylist(), dims)
            whitened = np.full((len(x), count), np.nan)
            whitened[:, :found] = project(x)
            every = pa.array(np.repeat(np.arange(len(x)), count))
            flat = whitened.ravel()
            columns = [
                batch.column(0).take(every),
                pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                pa.array(np.full(len(every), n), pa.int64()),
                pa.array(deviations(x, n, sums), pa.int64()).take(every),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(np.tile(shares, len(x)), pa.float64()),
                pa.array(np.full(len(every), error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(
        run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return made.withColumnRenamed("id", id_col)
