"""Embedding whitening by QDWH spectral divide and conquer.

Vectors are rounded to integers, so counts and sums are exact. Spark makes the list of distinct vectors, sums it, and sums
the products of the centred vectors, each task giving one matrix; a matrix of dimensions squared is all that reaches the
driver. There the covariance is split: the polar factor of the covariance less a shift, by the dynamically weighted Halley
iteration (QDWH), has eigenvalues 1 above the shift and -1 below it, so half of it plus the identity projects on the space
above. An orthonormal basis of that space and of the rest turns the covariance into two smaller blocks, which are split in
turn until they are numbers, or multiples of the identity. The components, divided by the roots of their eigenvalues, are
then broadcast (dimensions times components numbers) and every row is whitened by one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import settled, task_sums, tuned

SCALE = 256
COMPONENTS = 4
_EPS = np.finfo(float).eps
_MOST_LONG = 2**63 - 1


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that is not singular, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # A lower bound of the smallest singular value, from the triangular factor.
    r = np.linalg.qr(x, mode="r")
    smallest = np.abs(np.diag(r)).min()
    low = _EPS
    if smallest > n * _EPS:
        low = max(_EPS, 1 / (np.linalg.norm(np.linalg.inv(r)) * (1 + n * _EPS)))
    eye = np.eye(n)
    for _ in range(40):
        low = min(low, 1.0)
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        alpha = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        before = x
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, eye]))
            x = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:n] @ q[n:].T)
        else:
            x = beta / gamma * x + (alpha - beta / gamma) * np.linalg.solve(eye + gamma * (x.T @ x), x.T).T
        x = (x + x.T) / 2
        low = low * (alpha + beta * square) / (1 + gamma * square)
        if abs(1 - low) < 10 * _EPS and np.linalg.norm(x - before) <= np.cbrt(_EPS) * np.linalg.norm(x):
            break
    return x


def _split(a: np.ndarray, noise: float) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first columns span the eigenvalues above a shift, and their number; None: no such shift."""
    n = len(a)
    random = np.random.default_rng(n)
    middle, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    best = None
    # The median splits evenly, the mean always splits. A shift next to an eigenvalue is moved.
    for shift in (np.median(np.diag(a)), middle, *(middle + spread * t for t in (0.05, -0.05, 0.2, -0.2, 0.5, -0.5))):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        # The space of the projector, from as many of its mixtures; once more, to have it to full precision.
        basis, _ = np.linalg.qr(projector @ random.standard_normal((n, k)), mode="complete")
        basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :k], basis[:, k:] - projector @ basis[:, k:]]))
        apart = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or apart < best[0]:
            best = apart, basis, k
        if apart <= noise:
            break
    return best and best[1:]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    values, vectors = np.zeros(n), np.zeros((n, n))
    if not n:
        return values, vectors
    a = (a + a.T) / 2
    noise = 4 * _EPS * n * np.linalg.norm(a)
    open_ = [(a, np.eye(n), 0)]
    while open_:
        block, basis, start = open_.pop()
        size = len(block)
        flat = np.linalg.norm(block - np.trace(block) / size * np.eye(size)) <= _EPS * np.linalg.norm(a)
        split = None if size == 1 or flat else _split(block, noise)
        if split is None:
            # A multiple of the identity: any basis of its space will do.
            values[start : start + size], vectors[:, start : start + size] = np.diag(block), basis
            continue
        turned, k = split
        block = turned.T @ block @ turned
        block = (block + block.T) / 2
        open_.append((block[:k, :k], basis @ turned[:, :k], start))
        open_.append((block[k:, k:], basis @ turned[:, k:], start + k))
    values = (vectors * (a @ vectors)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def rounded(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, x): the rows whose vector is whole, as a struct, and the vector as integers.

    A null vector, one with null or non-finite entries, and one shorter than the longest vector go.
    """
    entry = lambda c: c.cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf"))
    vector = F.col(f"`{vector_col}`")
    kept = rows.where(vector.isNotNull() & F.forall(vector, finite))
    x = F.transform(F.col(f"row.`{vector_col}`"), lambda c: F.floor(entry(c) * scale).cast("long"))
    whole = kept.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")).withColumn("x", x)
    return whole.where(F.size("x") == whole.agg(F.max(F.size("x"))).scalar())


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Number of the vectors and their sum, both exact; a sum beyond the range of long is an error."""
    dims = F.posexplode("x").alias("at", "value")
    sums = distinct.select(dims).groupBy("at").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    found = sums.orderBy("at").collect()
    return (found[0]["n"] if found else 0), [r["total"] for r in found]


class Whitening:
    """What is fitted: n, the exact sums, the components (columns) with their eigenvalues, and the total variance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.mean = np.array([s / n for s in sums])

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S) squared, exact; an error if it is no long."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest * largest * max(1, len(self.sums)) <= _MOST_LONG else object
        apart = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        found = [int(d) for d in (apart * apart).sum(axis=1)]
        if found and max(found) > _MOST_LONG:
            raise OverflowError("a deviation is beyond the range of long")
        return found


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a written list of vectors ``x``; None without vectors. Directions without variance are no components."""
    n, sums = exact_sums(distinct)
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def products(batch):
        centred = _matrix(batch) - mean
        return centred.T @ centred

    covariance = task_sums(distinct, products).reshape(len(sums), -1) / n if sums else np.zeros((0, 0))
    values, vectors = eigenvectors(covariance)
    most = values[0] if len(values) else 0.0
    kept = int(np.sum(values[:components] > len(values) * _EPS * most))
    return Whitening(n, sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)))


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened list minus the identity; 0 without components."""
    k = len(fitted.values)
    if not k:
        return 0.0

    def moments(batch):
        w = fitted.whitened(_matrix(batch))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = task_sums(distinct, moments).reshape(k + 1, k) / fitted.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error) of every row with a whole vector.

    ``row`` holds all columns of the row, so no name of theirs can clash. ``whitened`` and ``explained`` have an entry per
    component, in order of falling variance, and fewer than ``components`` where the list has no more directions of
    variance; a list of one vector has none. The fit list is every distinct vector once, so repeated rows count once and
    all get a result. An empty table gives no row.
    """
    whole = settled(rounded(rows, vector_col, scale), "whitening-rows")
    distinct = settled(whole.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-list")
    fitted = fit(distinct, components)
    numbers = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if fitted is None:
        return whole.select("row", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in numbers.split(", ")))
    error = identity_error(distinct, fitted)
    explained = (fitted.values / fitted.trace).tolist() if len(fitted.values) else []
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            w = model.whitened(x) if len(model.values) else np.zeros((len(x), 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([model.n] * len(x), pa.int64()),
                    pa.array(model.deviations(x), pa.int64()),
                    pa.array(w.tolist(), pa.list_(pa.float64())),
                    pa.array([explained] * len(x), pa.list_(pa.float64())),
                    pa.array([error] * len(x), pa.float64()),
                ],
                ["row", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, {numbers}")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with a whole vector and component up to four, with its whitened value."""
    rows = tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = whiten(rows)
    spread = found.select(
        F.col("row.vec_id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")
    )
    return spread.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", "at").alias("explained"), "identity_error",
    )
