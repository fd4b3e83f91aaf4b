"""Whitening of embeddings by a block Jacobi-Davidson eigensolver over distributed, matrix-free covariance products.

Each entry c of a vector becomes the integer x = floor(64 c) + 1000000. Counts and sums per dimension are exact integers. The
covariance V of x is never formed: a product V B with a block B of directions is one pass of Spark over the stored integers, in
which every task centres its rows, projects them on B and sends back one matrix of the block's size (tasks' matrices
are added up by other tasks before the driver adds the rest).

Jacobi-Davidson: Rayleigh-Ritz over a search space gives approximate eigenpairs; for each pair that hasn't converged the
projected correction equation (I - QQ')(V - theta I)(I - QQ') t = -r is solved roughly by INNER steps of MINRES, all
pairs' steps side by side so that a step is one product; the corrections widen the search space. Pairs are locked in falling order of
their values, as soon as their residual is down to rounding error (TOLERANCE times the largest value times the root of the
dimension); the rest is solved orthogonal to them. A space of more than MOST_BLOCKS blocks restarts from its best Ritz vectors.

The driver holds dimension times block numbers, whatever the rows.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; of vectors of different lengths those of
the most frequent length stay (of equally frequent ones the longest); vectors without entries have no components and give no rows;
null and repeated vec_ids are rows like others; an integer beyond 53 bits is rounded as doubles are and held within 62 bits; a deviation beyond 63 bits is null. Where an eigenvalue is 0 but for
rounding (fewer distinct rows than components, constant dimensions) whitened is null, and identity_error leaves that component out; with trace 0
explained is null. Equal eigenvalues: any orthonormal basis of their space. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import store, task_sums

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
GUARD, INNER, MOST_BLOCKS, MOST_ROUNDS, TOLERANCE = 8, 4, 4, 200, 2e-14
#: An eigenvalue below this share of the largest is 0 but for rounding.
ZERO = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Exact counts and sums (of x less SHIFT), eigenvalues in falling order, unit eigenvectors as columns, trace and the identity's error."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    residual: float


def kept(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, size and the vector's integers less SHIFT, as bytes, of the rows that stay; a stored table."""
    v = F.col(vector_column).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = embeddings.where(fine).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE), -(2.0 ** 62), 2.0 ** 62).astype("<i8").tobytes()
            ends = (np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) * 8).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) // 8, pa.int32()), pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["vec_id", "size", "x"])

    table = store(rows.mapInArrow(run, "vec_id long, size int, x binary"), "whitening-rows")
    sizes = table.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return table.where(F.col("size") == (sizes[0]["size"] if sizes else 0))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, size)


def size_of(rows: DataFrame) -> int:
    first = rows.select("size").head()
    return first["size"] if first else 0


def counted(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums per dimension."""
    def fold(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        n, sums = 0, np.zeros(size, object)
        for batch in batches:
            x = matrix(batch.column(0), size)
            n += len(x)
            # halves of 32 bits can't overflow in a batch
            sums = sums + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        return (n, sums) if n else None

    return task_sums(rows.select("x"), fold) or (0, np.zeros(size, object))


def product(rows: DataFrame, mean: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, float]]:
    """B -> (sum over rows of (x - mean)(x - mean)'B, sum of squares of x - mean): one pass."""
    size = len(mean)

    def times(block: np.ndarray) -> tuple[np.ndarray, float]:
        def fold(batches: Iterator[pa.RecordBatch]) -> tuple | None:
            total, squares, any_row = np.zeros_like(block), 0.0, False
            for batch in batches:
                c = matrix(batch.column(0), size) - mean
                total += c.T @ (c @ block)
                squares += float(np.einsum("ij,ij->", c, c))
                any_row = any_row or len(c) > 0
            return (total, squares) if any_row else None

        return task_sums(rows.select("x"), fold) or (np.zeros_like(block), 0.0)

    return times


def orthogonal(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what the block adds to the bases."""
    for _ in range(2):
        for q in bases:
            block = block - q @ (q.T @ block)
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 1e-14] / norms[norms > 1e-14]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10 * s[0]]
    for q in bases:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0]


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems apply(t) = right, column by column side by side, from 0 by so many steps."""
    norm = np.linalg.norm(right, axis=0)
    safe = lambda x: np.where(np.abs(x) > 1e-300, x, 1.0)
    v, v_old, x = right / safe(norm), np.zeros_like(right), np.zeros_like(right)
    d, d_old = np.zeros_like(right), np.zeros_like(right)
    beta, eta = np.zeros_like(norm), norm.copy()
    c, c_old, s, s_old = np.ones_like(norm), np.ones_like(norm), np.zeros_like(norm), np.zeros_like(norm)
    for _ in range(steps):
        w = apply(v) - beta * v_old
        alpha = np.einsum("ij,ij->j", v, w)
        w = w - alpha * v
        following = np.linalg.norm(w, axis=0)
        # the two last rotations on the new column of the Lanczos matrix, then one of its own
        top = s_old * beta
        middle = c * c_old * beta + s * alpha
        corner = c * alpha - s * c_old * beta
        length = np.hypot(corner, following)
        c_old, s_old = c, s
        c, s = np.where(length > 0, corner / safe(length), 1.0), np.where(length > 0, following / safe(length), 0.0)
        d, d_old = (v - middle * d - top * d_old) / safe(length), d
        step = np.where(length > 1e-300, c * eta, 0.0)
        x = x + step * d
        eta = -s * eta
        v, v_old, beta = np.where(following > 1e-14 * np.maximum(np.abs(alpha), 1e-300), w / safe(following), 0.0), v, following
    return x


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, inner: int = INNER, most_blocks: int = MOST_BLOCKS) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest eigenvalues of a symmetric matrix given by its products with blocks, their unit vectors and the largest residual."""
    wanted = min(wanted, size)
    width = min(size, wanted + GUARD)
    space = np.linalg.qr(np.random.default_rng(12).standard_normal((size, width)))[0]
    image = times(space)
    locked, values, left = np.zeros((size, 0)), np.zeros(0), 0.0
    worst = np.inf
    for _ in range(MOST_ROUNDS):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        residual = image - space * theta
        residual = residual - locked @ (locked.T @ residual)
        size_of_residual = np.linalg.norm(residual, axis=0)
        greatest = max(abs(values).max(initial=0.0), abs(theta).max(initial=0.0))
        limit = TOLERANCE * greatest * np.sqrt(size)
        missing = wanted - len(values)
        whole = space.shape[1] + len(values) >= size  # nothing is left to search: only rounding is
        good = int(np.argmin(np.append(size_of_residual[:missing] <= limit, False)))
        if whole:
            good = missing
        left = max(left, size_of_residual[:good].max(initial=0.0))
        locked, values = np.concatenate((locked, space[:, :good]), axis=1), np.concatenate((values, theta[:good]))
        space, image, theta, residual = space[:, good:], image[:, good:], theta[good:], residual[:, good:]
        missing -= good
        if not missing:
            break
        open_block = slice(0, min(space.shape[1], missing + GUARD))
        if space.shape[1] + width > most_blocks * max(width, 1):
            keep = min(space.shape[1], 2 * (missing + GUARD))
            space, image = space[:, :keep], image[:, :keep]
        ritz, values_of_block = space[:, open_block], theta[open_block]
        q = np.concatenate((locked, ritz), axis=1)

        def projected(t: np.ndarray, q: np.ndarray = q, shift: np.ndarray = values_of_block) -> np.ndarray:
            t = t - q @ (q.T @ t)
            t = times(t) - t * shift
            return t - q @ (q.T @ t)

        r = residual[:, open_block]
        step = minres(projected, -(r - q @ (q.T @ r)), inner)
        fresh = orthogonal(step, locked, space)
        if not fresh.shape[1]:  # corrections drown in rounding: search elsewhere
            fresh = orthogonal(np.random.default_rng(len(values)).standard_normal((size, width)), locked, space)
        space, image = np.concatenate((space, fresh), axis=1), np.concatenate((image, times(fresh)), axis=1)
    else:
        raise ArithmeticError(f"eigenvectors did not converge in {MOST_ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    locked, values = locked[:, order], values[order]
    return values, locked * np.sign(locked[np.abs(locked).argmax(axis=0), np.arange(locked.shape[1])] + 0.0), left


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Over all kept rows."""
    size = size_of(rows)
    if not size:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, None, 0.0)
    n, sums = counted(rows, size)
    mean = np.array([s / n for s in sums], np.float64)
    run = product(rows, mean)
    trace = run(np.zeros((size, 1)))[1] / n
    values, vectors, residual = eigenpairs(lambda b: run(b)[0] / n, size, components)
    values = np.where(values > ZERO * max(values.max(), 1e-300), values, 0.0)
    return Whitening(n, tuple(sums), values, vectors, trace, identity_error(rows, mean, n, values, vectors), residual)


def identity_error(rows: DataFrame, mean: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity: one pass over the whitened values themselves."""
    used = values > 0
    if not used.any():
        return None
    to, size = vectors[:, used] / np.sqrt(values[used]), len(mean)

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        return (matrix(batch.column(0), size) - mean) @ to

    def first(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        total = [whitened(b).sum(axis=0) for b in batches if b.num_rows]
        return (np.sum(total, axis=0),) if total else None

    centre = task_sums(rows.select("x"), first)[0] / n

    def second(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        total = [(w.T @ w) for w in (whitened(b) - centre for b in batches if b.num_rows)]
        return (np.sum(total, axis=0),) if total else None

    return float(np.abs(task_sums(rows.select("x"), second)[0] / n - np.eye(used.sum())).max())


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row per kept row and component."""
    size, k, n = len(model.sums), len(model.values), model.n
    sums = np.array(model.sums, object)
    mean = np.array([s / n for s in model.sums], np.float64) if n else np.zeros(0)
    used = model.values > 0
    to = np.where(used, model.vectors / np.sqrt(np.where(used, model.values, 1.0)), 0.0) if k else np.zeros((size, 0))
    explained = pa.array([float(v / model.trace) if model.trace > 0 else None for v in model.values], pa.float64())

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact: in 64 bits where they can't overflow, else in Python's integers."""
        ends = [max(abs(int(a) * n - s), abs(int(b) * n - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), model.sums)]
        widest = max(ends)
        if widest * widest * size < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
            d = x * np.int64(n) - sums.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum(int(e) ** 2 for e in row) for row in x.astype(object) * n - sums]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048) if k else ():
                part = batch.slice(at, 2048)
                x, m = matrix(part.column(1), size), part.num_rows
                index = np.repeat(np.arange(m), k)
                w = pa.array(((x - mean) @ to).ravel(), mask=np.tile(~used, m))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(deviations(x), pa.int64()).take(pa.array(index)), w, explained.take(pa.array(np.tile(np.arange(k), m))),
                     pa.array([model.identity_error] * (m * k), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Fit on all kept rows, then apply to each."""
    rows = kept(embeddings, id_column, vector_column)
    return apply(rows, fit(rows, components))
