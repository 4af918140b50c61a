"""Embedding whitening by principal axes, found with a block Jacobi-Davidson method.

The covariance of the vectors is never formed. Spark computes its product with a few directions at a time: each
task centres its vectors, multiplies, and returns one small matrix. On the driver the method keeps a search
space of such directions. Rayleigh-Ritz takes the best approximations from it; for each that is not yet exact, a
correction orthogonal to all approximations is found by MINRES on the projected equation; the corrections enter the
space. All equations advance together, one read of the data per step. Pairs whose residual has reached double precision are
locked and taken out of the space, which is then searched for the rest.

``integer_vectors`` drops vectors that are null, hold null or non-finite entries, or entries of 2**55 and
more; of the others it keeps those of the most frequent length (of equally frequent ones the longest). Entries become
``floor(256 * c)``. The covariance is that of the distinct vectors, so copies have no weight, with their number as divisor.

Directions with less than ``FLAT`` of the variance have a null ``whitened``, as all have where fewer than two distinct vectors exist. An empty
table gives an empty result. Null ids and repeated rows are rows like others; other columns are not looked at. A
deviation beyond 64 bits is null.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import written

SCALE = 256
COMPONENTS = 4
TOLERANCE = 64 * np.finfo(float).eps  # residual over the largest eigenvalue; that of a product is about a tenth
BEYOND = 4  # directions searched besides those wanted
MOST = 28  # directions in the search space before it is cut back
INNER = 12  # MINRES steps per correction
ROUNDS = 200
FLAT = 1e-10  # variance below this share of the total counts as none
SLICE = 1 << 22  # numbers of a task's vectors held as doubles at once
COLLECTED = 512  # arrays of sums that reach the driver or one task at a time


@dataclass
class Axes:
    """Mean, unit directions (one per row), variances, total variance, residuals and number of vectors."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(df: DataFrame, col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``x``, the vectors in 256ths, rounded down."""
    c = F.transform(F.col(col), lambda v: v.cast("double"))
    most = float(2**63 // SCALE)
    sound = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < most), F.lit(False)))
    rows = df.select(F.col(id_col).alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & sound & (F.size("c") > 0))
    x = rows.select("vec_id", F.transform("c", lambda v: F.floor(SCALE * v).cast("long")).alias("x"))
    lengths = x.groupBy(F.size("x").alias("d")).count()
    usual = lengths.agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    return x.where(F.size("x") == (usual or 0))


def _vectors(batches: Iterator[pa.RecordBatch], d: int, at: int = 0) -> Iterator[np.ndarray]:
    """The vectors as long numbers, a bounded number of them at a time."""
    step = max(1, SLICE // d)
    for batch in batches:
        flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
        for k in range(0, batch.num_rows, step):
            yield flat[k * d : (k + step) * d].reshape(-1, d)


class Sums:
    """Sums over all vectors of a table; every task returns one small array."""

    def __init__(self, fit: DataFrame, d: int) -> None:
        self.fit, self.d = fit.select("x"), d
        self.tasks = fit.select(F.spark_partition_id().alias("p")).distinct().count()

    def of(self, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of what ``add`` makes of some vectors, added in one order whatever task ends first.

        Where there are many tasks, others add up their arrays before any reach the driver.
        """
        d = self.d

        def row(total) -> Iterator[pa.RecordBatch]:
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

        def over_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for x in _vectors(batches, d):
                part = add(x)
                total = part if total is None else total + part
            yield from row(total)

        def over_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for one in batch.column(0):
                    part = pickle.loads(one.as_py())
                    total = part if total is None else total + part
            yield from row(total)

        parts, rows = self.fit.mapInArrow(over_vectors, "sums binary"), self.tasks
        while rows > COLLECTED:
            rows = -(-rows // COLLECTED)
            parts = parts.repartition(rows).mapInArrow(over_arrays, "sums binary")
        found = sorted((pickle.loads(r[0]) for r in parts.collect()), key=lambda a: a.tobytes() if a.dtype != object else 0)
        return sum(found[1:], found[0])


def minres(theta: float, project: Callable, rhs: np.ndarray, steps: int, tol: float):
    """MINRES for (A - theta) t = rhs between ``project``; yields vectors, takes their products with A, returns t."""
    r = project(rhs)
    beta = np.linalg.norm(r)
    t = np.zeros_like(r)
    if beta == 0:
        return t
    v, v_old = r / beta, np.zeros_like(r)
    w, w_old = np.zeros_like(r), np.zeros_like(r)
    eta, first = beta, beta
    c_old = c = 1.0
    s_old = s = beta_v = 0.0
    for _ in range(steps):
        a = yield v
        u = project(a - theta * v)
        alpha = v @ u
        u = u - alpha * v - beta_v * v_old
        u = project(u)
        beta_next = np.linalg.norm(u)
        # two rotations bring the tridiagonal column into triangular form
        delta = c * alpha - c_old * s * beta_v
        gamma = np.hypot(delta, beta_next)
        epsilon = s * alpha + c_old * c * beta_v
        zeta = s_old * beta_v
        if gamma == 0:
            break
        c_old, s_old, c, s = c, s, delta / gamma, beta_next / gamma
        w, w_old = (v - zeta * w_old - epsilon * w) / gamma, w
        t = t + c * eta * w
        eta = -s * eta
        if abs(eta) <= tol * first or beta_next <= 1e-14 * first:
            break
        v, v_old, beta_v = u / beta_next, v, beta_next
    return t


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the columns of ``against``; dependent ones go."""
    kept: list[np.ndarray] = []
    for v in block.T:
        size = np.linalg.norm(v)
        if size == 0 or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            for q in (against, np.array(kept).T if kept else np.zeros((len(v), 0))):
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept.append(v)
    return np.array(kept).T if kept else np.zeros((len(block), 0))


def _corrections(product: Callable, theta: np.ndarray, residuals: np.ndarray, known: np.ndarray, tol: float) -> np.ndarray:
    """Solutions of the correction equations, advanced together: one product per step for all that still run."""
    project = lambda v: v - known @ (known.T @ v)
    solving = {k: minres(theta[k], project, -residuals[:, k], INNER, tol) for k in range(len(theta))}
    asked, done = {}, {}
    for k, solver in solving.items():
        try:
            asked[k] = next(solver)
        except StopIteration as end:
            done[k] = end.value
    while asked:
        names = list(asked)
        images = product(np.column_stack([asked.pop(k) for k in names]))
        for k, image in zip(names, images.T):
            try:
                asked[k] = solving[k].send(image)
            except StopIteration as end:
                done[k] = end.value
    return np.column_stack([done[k] for k in range(len(theta))])


def largest_pairs(product: Callable, d: int, want: int, scale: float, tolerance: float = TOLERANCE, seed: int = 7):
    """Eigenvalues, unit eigenvectors (columns) and residuals of the ``want`` largest pairs of a symmetric operator.

    ``product`` maps a block of columns to their images; ``scale`` is a bound of the largest eigenvalue.
    """
    want = min(want, d)
    locked, values, errors = np.zeros((d, 0)), [], []
    space = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, want + BEYOND))), locked)
    images = product(space)
    for turn in range(ROUNDS):
        if not space.shape[1]:
            space = _orthonormal(np.random.default_rng(seed + turn).standard_normal((d, want)), locked)
            images = product(space)
        h = space.T @ images
        theta, inner = np.linalg.eigh((h + h.T) / 2)
        theta, inner = theta[::-1], inner[:, ::-1]
        open_ = min(want - len(values), space.shape[1])
        ritz = space @ inner[:, :open_]
        residuals = images @ inner[:, :open_] - ritz * theta[:open_]
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        top = max([scale * 1e-300, *values, theta[0]])
        ready = 0
        while ready < open_ and sizes[ready] <= tolerance * top:
            ready += 1
        if ready:  # the images are sums of older ones; what is locked is judged by a fresh product
            sizes[:ready] = np.linalg.norm(product(ritz[:, :ready]) - ritz[:, :ready] * theta[:ready], axis=0)
            fresh = int(np.argmax(np.append(sizes[:ready] > tolerance * top, True)))
            if fresh < ready:
                images = product(space)
            ready = fresh
        if ready:
            locked = np.column_stack([locked, ritz[:, :ready]])
            values += list(theta[:ready])
            errors += list(sizes[:ready])
            space, images = space @ inner[:, ready:], images @ inner[:, ready:]
            theta, inner = theta[ready:], np.eye(space.shape[1])
            ritz, residuals = ritz[:, ready:], residuals[:, ready:]
            open_ -= ready
        if len(values) == want:
            break
        if space.shape[1] + open_ > MOST:
            keep = min(space.shape[1], want + BEYOND + open_)
            space, images = space @ inner[:, :keep], images @ inner[:, :keep]
        if open_ and ritz.shape[1]:
            more = _corrections(product, theta[:open_], residuals, np.column_stack([locked, ritz]), 0.5 ** min(turn + 1, 12))
        else:  # everything found so far is locked: search anew
            more = np.random.default_rng(seed + turn + 1).standard_normal((d, want - len(values)))
        new = _orthonormal(more, np.column_stack([locked, space]))
        if not new.shape[1]:  # nothing left to add but noise
            new = _orthonormal(np.random.default_rng(seed - turn - 1).standard_normal((d, 1)), np.column_stack([locked, space]))
        if new.shape[1]:
            space, images = np.column_stack([space, new]), np.column_stack([images, product(new)])
        else:  # the space is everything, so its pairs are exact up to rounding: compute the images afresh
            images = product(space)
    else:
        raise ArithmeticError(f"{len(values)} of {want} pairs reached double precision in {ROUNDS} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(errors)[order]


def principal_axes(fit: DataFrame, components: int = COMPONENTS) -> Axes | None:
    """The leading axes of the rows of ``fit``, each counted once; ``x`` is their vector. None for an empty table."""
    one = fit.select(F.size("x").alias("d")).first()
    if one is None:
        return None
    sums_of = Sums(fit, one.d)

    def exactly(x: np.ndarray) -> np.ndarray:
        if int(np.abs(x).max()) ** 2 * len(x) >= 2**62:
            x = x.astype(object)
        return np.array([[len(x)] * x.shape[1], x.sum(axis=0), (x * x).sum(axis=0)], object)

    exact = sums_of.of(exactly)
    d, n, sums = one.d, int(exact[0, 0]), [int(s) for s in exact[1]]
    trace = sum(n * int(q) - s * s for s, q in zip(sums, exact[2])) / n**2
    mean = np.array([s / n for s in sums])
    if trace == 0:
        return Axes(n, sums, np.eye(d)[: min(components, d)], np.zeros(min(components, d)), 0.0, np.zeros(min(components, d)))

    def product(block: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return sums_of.of(add) / n

    values, vectors, errors = largest_pairs(product, d, components, trace)
    return Axes(n, sums, vectors.T, values, trace, errors / values[0])


def _scales(axes: Axes) -> np.ndarray:
    """Per direction the factor of its projection; nan without variance."""
    flat = axes.variances <= FLAT * axes.trace
    return np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, axes.variances)))


def identity_error(fit: DataFrame, axes: Axes) -> float | None:
    """Largest entry, by size, of the covariance of the whitened rows less the identity; None without any variance."""
    scale = _scales(axes)
    used = np.flatnonzero(np.isfinite(scale))
    if not len(used):
        return None
    d, m = len(axes.sums), len(used)
    to = (axes.directions[used] * scale[used, None]).T
    mean = axes.mean

    def add(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ to
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = Sums(fit, d).of(add) / axes.n
    cover = sums[m:].reshape(m, m) - np.outer(sums[:m], sums[:m])
    return float(np.abs(cover - np.eye(m)).max())


def whitened(rows: DataFrame, axes: Axes) -> DataFrame:
    """Per row of ``rows`` its ``whitened`` array, one number per axis, beside its columns."""
    to = (axes.directions * _scales(axes)[:, None]).T
    mean, d, m = axes.mean, len(axes.sums), len(axes.variances)
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.concatenate([np.zeros((0, m)), *[(x - mean) @ to for x in _vectors([batch], d, at)]])
            flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z).ravel())
            ends = pa.array(np.arange(0, z.size + 1, m), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], [*batch.schema.names, "whitened"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, whitened array<double>")


def whitening_report(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: the whitened value, the exact deviation and how well the axes whiten."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
        "eigenvalue double, residual double"
    )
    rows = integer_vectors(df)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    axes = principal_axes(fit, components)
    if axes is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, axes)
    # (n x - S)^2 over all dimensions, in whole numbers
    apart = F.zip_with("x", F.array(*[F.lit(s) for s in axes.sums]), lambda x, s: F.try_subtract(F.try_multiply(F.lit(axes.n).cast("long"), x), s.cast("long")))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    facts = [
        F.struct(
            F.lit(k + 1).alias("component"),
            F.lit(float(e / axes.trace) if axes.trace else None).cast("double").alias("explained"),
            F.lit(float(e)).alias("eigenvalue"),
            F.lit(float(r)).alias("residual"),
        )
        for k, (e, r) in enumerate(zip(axes.variances, axes.residuals))
    ]
    shown = whitened(rows, axes).withColumn("deviation", deviation)
    return shown.select("vec_id", "deviation", "whitened", F.inline(F.array(*facts))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("component").cast("int").alias("component"),
        F.lit(axes.n).cast("long").alias("n"),
        "deviation",
        F.get("whitened", F.col("component") - 1).alias("whitened"),
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
        "eigenvalue",
        "residual",
    )
