"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson, without forming the matrix.

The only thing done with the covariance V is V times a few vectors, as a Spark job over all distinct vectors: each task
sums x (x . v) over its vectors, centred first, and what comes to the driver is one d by k block for each task of a bounded
number of summing tasks. The rest is algebra on d by k blocks:

* Rayleigh-Ritz on the search space gives Ritz pairs; leading pairs whose residuals are at the floor of double
  precision are locked, in order.
* For the others, (I - P P') (V - theta I) (I - P P') t = -r is solved by MINRES, where P holds the locked and the Ritz
  vectors. All pairs take their steps together, so a step is one product with V.
* The corrections, orthogonalised twice, extend the search space, which is cut back to its Ritz vectors when full.

Entries are whole numbers: small after a common shift, so centred products lose nothing to cancellation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmline.llm.workers import once, share
from ohmline.shared import cut, drop_table, ship, without

ship(__name__)

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Vectors in one packed row; tasks whose sums are added up before they come to the driver.
PACK, SUMS = 2048, 16
#: Ritz vectors beside the wanted ones, vectors of the search space, steps of MINRES, rounds.
GUARD, SPACE, STEPS, ROUNDS = 8, 96, 24, 60
#: Residuals count as zero below so many units in the last place of the largest eigenvalue.
ULPS = 64
FITTED = "vec_id long, deviation long, whitened array<double>"


def whole(vector: Column) -> Column:
    """floor(64 c) of each entry as a long; the common shift of a million is added where sums are named."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite entries only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """The vectors ``x`` as rows of up to ``PACK`` of them: n, body (doubles, which hold these whole numbers exactly)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, size)
            parts = [flat[i : i + PACK] for i in range(0, len(flat), PACK)]
            yield pa.record_batch([pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "body"])

    return vectors.mapInArrow(pack, "n int, body binary")


def totals(blocks: DataFrame, size: int, rows: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all packed vectors of ``work`` (matrix of vectors -> array), added up by ``SUMS`` tasks and then here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column("body"):
                own = work(np.frombuffer(body.as_buffer(), np.float64).reshape(-1, size))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column("part"):
                own = np.frombuffer(body.as_buffer(), np.float64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = blocks.select("body").mapInArrow(part, "part binary")
    if rows > PACK * 64 * SUMS:  # else there are fewer parts than it would take tasks to add them
        parts = parts.repartition(SUMS).mapInArrow(add, "part binary")
    found = [np.frombuffer(r["part"], np.float64) for r in parts.collect()]
    return np.sum(found, axis=0)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of whole numbers as two doubles each, whose sums over many tasks stay exact."""
    if np.abs(x).max(initial=0) < 1 << 50:
        sums = [int(s) for s in x.astype(np.int64).sum(axis=0)]
    else:
        sums = [sum(map(int, column)) for column in x.T]
    return np.array([float(s >> 26) for s in sums] + [float(s & (1 << 26) - 1) for s in sums])


def moments(w: np.ndarray) -> np.ndarray:
    """Sums of products and sums of the columns of ``w``."""
    return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))


class Covariance:
    """The covariance of packed vectors as a product with blocks of vectors."""

    def __init__(self, blocks: DataFrame, size: int, n: int, sums: list[int]):
        self.blocks, self.size, self.n, self.products = blocks, size, n, 0
        self.mean = np.array([s / n for s in sums])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        context, self.products = self.blocks.sparkSession.sparkContext, self.products + 1
        shared = context.broadcast((self.mean, v))

        def work(x: np.ndarray) -> np.ndarray:
            mean, block = shared.value
            centred = x - mean
            return (centred.T @ (centred @ block)).ravel()

        out = totals(self.blocks, self.size, self.n, work).reshape(v.shape) / self.n
        shared.destroy()
        return out


def orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``v`` add to those of ``against``; directions that add nothing are left out."""
    v = v / np.maximum(np.linalg.norm(v, axis=0), 1e-300)
    for _ in range(2):
        v = v - against @ (against.T @ v)
        q, r = np.linalg.qr(v)
        v = q[:, np.abs(np.diag(r)) > 1e-10]
    return v


def minres(product, b: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """MINRES from zero for all columns of ``b`` at once, until every residual has fallen to the part ``drop`` or after ``steps``."""
    x, norm = np.zeros_like(b), np.linalg.norm(b, axis=0)
    live = norm > 0
    before, now = np.zeros_like(b), b / np.where(live, norm, 1)
    d1, d2 = np.zeros_like(b), np.zeros_like(b)
    beta, c, s, c0, s0, rest = np.zeros_like(norm), np.ones_like(norm), np.zeros_like(norm), np.ones_like(norm), np.zeros_like(norm), norm.copy()
    for _ in range(steps):
        w = product(now)
        alpha = np.sum(now * w, axis=0)
        w = w - alpha * now - beta * before
        after = np.linalg.norm(w, axis=0)
        high, low = s0 * beta, c0 * beta  # the column's entries above the diagonal, turned by the last two rotations
        mid, diagonal = c * low + s * alpha, c * alpha - s * low
        r = np.hypot(diagonal, after)
        safe = np.where(r > 0, r, 1)
        c0, s0, c, s = c, s, diagonal / safe, after / safe
        d = (now - mid * d1 - high * d2) / safe
        x = x + np.where(live & (r > 0), c * rest, 0) * d
        rest = -s * rest
        d2, d1 = d1, d
        live = live & (np.abs(rest) > drop * norm) & (after > 1e-14 * np.maximum(np.abs(alpha), 1e-300))
        if not live.any():
            break
        before, now, beta = now, w / np.where(after > 0, after, 1), after
    return x


def jacobi_davidson(matrix, size: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors, of a symmetric matrix known by its products."""
    wanted = min(wanted, size)
    width = min(wanted + GUARD, size)
    space = orthonormal(np.random.default_rng(seed).standard_normal((size, width)), np.zeros((size, 0)))
    image = matrix @ space
    locked, values, worst = np.zeros((size, 0)), [], np.inf
    for turn in range(ROUNDS):
        theta, turned = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turned = theta[::-1], turned[:, ::-1]
        ritz, images = space @ turned, image @ turned
        top = max([*values, *np.abs(theta), 1e-300])
        residual = images - ritz * theta
        norms, done = np.linalg.norm(residual - locked @ (locked.T @ residual), axis=0), 0
        missing = wanted - len(values)
        floor = ULPS * np.finfo(float).eps * top
        while done < missing and (norms[done] <= floor or space.shape[1] + len(values) >= size):
            done += 1
        locked, values = np.hstack((locked, ritz[:, :done])), values + list(theta[:done])
        if len(values) == wanted:
            return np.array(values), locked
        missing -= done
        space, image, theta, residual = ritz[:, done:], images[:, done:], theta[done:], residual[:, done:]
        if space.shape[1] + missing + GUARD > SPACE:
            space, image = space[:, : missing + GUARD], image[:, : missing + GUARD]
        aim = theta[:missing]
        basis = np.hstack((locked, space[:, : missing + GUARD]))
        off = lambda v: v - basis @ (basis.T @ v)
        b = off(-residual[:, :missing])
        t = minres(lambda v: off(matrix @ off(v) - off(v) * aim), b, STEPS, max(1e-6, 10.0 ** (-1 - turn)))
        more = orthonormal(t, np.hstack((locked, space)))
        if not more.shape[1]:
            more = orthonormal(np.random.default_rng(seed + turn).standard_normal((size, missing)), np.hstack((locked, space)))
        if more.shape[1]:
            space, image = np.hstack((space, more)), np.hstack((image, matrix @ more))
        worst = norms[: done + missing].max()
    raise ArithmeticError(f"{len(values)} of {wanted} eigenvectors after {ROUNDS} rounds, largest residual {worst}")


def projector(shared, size: int):
    """A function from (vec_id, x) to deviation and whitened components, by the broadcast mean, sums and projection."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, onto = once(shared, lambda x: x)
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.int64).reshape(batch.num_rows, size)
            most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
            if most * most * max(size, 1) < 1 << 63:
                deviation = ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1)
                deviation = pa.array(deviation, pa.int64())
            else:  # whole numbers of any length; what a long does not hold is null
                exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
                deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            white = (x - mean) @ onto
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), white.ravel())
            yield pa.record_batch([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    return project


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable vector and leading component.

    The fit list is each distinct vector of whole numbers floor(64 c) + 1000000 once; n is its length and S its sums.

    * Vectors that are null or hold null or non-finite entries are left out, and so are vectors whose length is not the
      most common one (of equally common lengths, the smallest). Rows with a null id or repeated ids keep their rows.
    * Components whose eigenvalue is zero, within rounding, can't be whitened and are left out: so are all of one vector
      or of equal ones. An empty table gives an empty result.
    * ``deviation`` is exact in whole numbers of any length; where it is beyond a long, it is null.
    * Other columns take no part.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None or not lengths["size"]:
        return spark.createDataFrame([], schema)
    size = lengths["size"]
    rows = rows.where(F.size("x") == size)
    blocks = cut(packed(rows.select("x").distinct(), size))
    n = blocks.agg(F.sum("n")).first()[0]
    exact = totals(blocks, size, n, exact_sums)
    sums = [int(a) * (1 << 26) + int(b) for a, b in zip(exact[:size], exact[size:])]
    matrix = Covariance(blocks, size, n, sums)
    mean = matrix.mean
    trace = float(totals(blocks, size, n, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    values, units = jacobi_davidson(matrix, size, components) if trace > 0 else (np.zeros(0), np.zeros((size, 0)))
    kept = values > size * 1e-14 * trace
    values, onto = values[kept], units[:, kept] / np.sqrt(values[kept])
    if not len(values):
        return spark.createDataFrame([], schema)
    second, first = np.split(totals(blocks, size, n, lambda x: moments((x - mean) @ onto)) / n, [len(values) ** 2])
    error = float(np.abs(second.reshape(len(values), -1) - np.outer(first, first) - np.eye(len(values))).max())
    drop_table(blocks)
    shared = share(spark.sparkContext, (n, sums, mean, onto))
    found = rows.mapInArrow(projector(shared, size), FITTED)
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
