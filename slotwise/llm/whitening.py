"""Whitening of embeddings by an incremental eigendecomposition.

Coordinates become whole numbers, ``floor(256 * c)``, and each distinct vector
is fitted once. Every partition holds a spectrum: row count, mean, and the
eigenvalues and eigenvectors of its scatter. Its rows come in blocks; a block,
less its mean, is cut to a triangular factor of at most as many rows as
dimensions, and each of those rows, and the shift between the means, is one
rank-one update: the secular equation gives the new eigenvalues, entries that
are too small or belong to equal eigenvalues are deflated. Spectra of
partitions are combined the same way, by the weighted eigenvectors of one as
updates of the other, a few spectra per task, round after round.

The basis so found is refined by one distributed Rayleigh-Ritz step: the scatter
of the rows in that basis, with the exact mean, is summed over all partitions
and its small eigenproblem turns the basis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.tables import read, without, write_out

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 4096
FAN = 8
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
SPECTRUM = "_part long, _n long, _mean binary, _values binary, _basis binary"
EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z^2 / (poles - x))``: nearest pole of each, and distance from it.

    ``poles`` rise strictly, no ``z`` is zero and ``rho`` is positive, so that a
    root lies right of each pole. Newton steps on the function freed of its
    nearest pole, halving the bracket where they leave it.
    """
    n = len(poles)
    weight = rho * z * z
    gap = np.append(np.diff(poles), weight.sum())
    middle = poles + gap / 2
    right = 1 + (weight / (poles[None, :] - middle[:, None])).sum(1) < 0
    right[-1] = False
    origin = np.arange(n) + right
    shifted = poles[None, :] - poles[origin][:, None]
    # distances from the origin: (0, gap/2] left of the middle, [-gap/2, 0) right of it
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    own = weight[origin]
    x = (low + high) / 2
    others = np.where(np.arange(n)[None, :] == origin[:, None], 0.0, weight[None, :])
    for _ in range(100):
        distance = shifted - x[:, None]
        terms = others / np.where(others == 0, 1.0, distance)
        slope = (terms / np.where(others == 0, 1.0, distance)).sum(1)
        rest = 1 + terms.sum(1)
        f = rest - own / x
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        # x * f has no pole at the origin
        step = x - (x * rest - own) / (rest + x * slope)
        step = np.where((step > low) & (step < high), step, (low + high) / 2)
        done = np.abs(step - x) <= EPS * np.abs(x)
        x = step
        if done.all():
            break
    return origin, x


class Spectrum:
    """Count, mean and scatter of some rows, the scatter as eigenvalues and eigenvectors (columns)."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def update(self, direction: np.ndarray) -> None:
        """Add ``direction`` times its transpose to the scatter."""
        d, z = self.values, self.basis.T @ direction
        length = np.linalg.norm(z)
        if length == 0:
            return
        z, rho = z / length, length * length
        order = np.argsort(d, kind="stable")
        d, z, basis = d[order], z[order], self.basis[:, order]
        scale = 8 * EPS * max(np.abs(d).max(), rho)
        # deflation: what barely meets the direction keeps its eigenpair ...
        live = np.flatnonzero(rho * np.abs(z) > scale)
        # ... and of two equal eigenvalues a rotation frees one
        kept: list[int] = []
        for j in live.tolist():
            if kept:
                i = kept[-1]
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if abs((d[j] - d[i]) * c * s) <= scale:
                    basis[:, [i, j]] = basis[:, [i, j]] @ np.array([[c, s], [-s, c]])
                    d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
                    z[i], z[j] = 0.0, r
                    kept.pop()
            kept.append(j)
        live = np.array(kept, np.int64)
        if len(live):
            poles = d[live]
            origin, x = secular_roots(poles, z[live], rho)
            # poles less roots, without cancellation
            gaps = (poles[None, :] - poles[origin][:, None]) - x[:, None]
            self._turn(basis, live, poles, z[live], gaps, rho)
            d[live] = poles[origin] + x
        self.values, self.basis = d, basis

    @staticmethod
    def _turn(basis, live, poles, z, gaps, rho) -> None:
        """Eigenvectors from the entries for which the computed roots are exact, which keeps them orthogonal."""
        n = len(poles)
        apart = poles[:, None] - poles[None, :]
        np.fill_diagonal(apart, 1.0)
        ratio = gaps / apart
        np.fill_diagonal(ratio, 1.0)
        size = np.sqrt(np.abs(-gaps[np.arange(n), np.arange(n)] / rho * ratio.prod(0)))
        exact = np.copysign(size, z)
        vectors = exact[None, :] / gaps
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        basis[:, live] = basis[:, live] @ vectors.T

    def add(self, n: int, mean: np.ndarray, directions: np.ndarray) -> None:
        """Take in ``n`` rows with their mean and a factor (rows) of their scatter."""
        if n == 0:
            return
        total = self.n + n
        shift = mean - self.mean
        if self.n:
            self.update(shift * np.sqrt(self.n / total * n))
        for row in directions:
            self.update(row)
        self.mean, self.n = self.mean + shift * (n / total), total

    def add_rows(self, rows: np.ndarray) -> None:
        mean = rows.mean(0)
        centred = rows - mean
        self.add(len(rows), mean, np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred)

    def add_spectrum(self, other: Spectrum) -> None:
        weights = np.sqrt(np.maximum(other.values, 0))
        self.add(other.n, other.mean, (other.basis * weights).T)

    def row(self, part: int) -> pa.RecordBatch:
        blobs = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (self.mean, self.values, self.basis)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), *blobs],
            ["_part", "_n", "_mean", "_values", "_basis"],
        )

    @classmethod
    def read(cls, n: int, mean: bytes, values: bytes, basis: bytes) -> Spectrum:
        mean, values = np.frombuffer(mean).copy(), np.frombuffer(values).copy()
        return cls(n, mean, values, np.frombuffer(basis).reshape(len(mean), -1).copy())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _spectra(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    spectrum = Spectrum.empty(d)
    for batch in batches:
        rows = _matrix(batch.column("_x"), d).astype(float)
        for start in range(0, len(rows), BLOCK_ROWS):
            spectrum.add_rows(rows[start : start + BLOCK_ROWS])
    if spectrum.n:
        yield spectrum.row(TaskContext.get().partitionId())


def _merged(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("_part")
    parts = [Spectrum.read(*(rows.column(c)[i].as_py() for c in rows.column_names[1:])) for i in range(rows.num_rows)]
    total = parts[0]
    for other in parts[1:]:
        total.add_spectrum(other)
    return pa.Table.from_batches([total.row(rows.column("_part")[0].as_py() // FAN)])


def spectrum(fit: DataFrame, d: int) -> Spectrum:
    """Spectrum of all rows of ``fit`` (column ``_x``), combined in rounds of ``FAN``."""
    parts = fit.rdd.getNumPartitions()
    found = write_out(fit.mapInArrow(lambda b: _spectra(b, d), SPECTRUM))
    while True:
        found = found.groupBy(F.floor(F.col("_part") / FAN)).applyInArrow(_merged, SPECTRUM)
        parts = -(-parts // FAN)
        if parts <= 1:
            return Spectrum.read(*found.first()[1:])


def _projected(batches, basis: np.ndarray, mean: np.ndarray, about: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums and products of the rows' coordinates in ``basis``, less ``about``."""
    d, k = basis.shape
    products, sums = np.zeros((k, k)), np.zeros(k)
    for batch in batches:
        at = (_matrix(batch.column("_x"), d) - mean) @ basis
        if about is not None:
            at = at - about
        products, sums = products + at.T @ at, sums + at.sum(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.append(products.ravel(), sums).tolist()])],
        ["_part", "_sums"],
    )


def projected(fit: DataFrame, basis: np.ndarray, mean: np.ndarray, about: np.ndarray | None = None):
    """Products and sums of all rows in ``basis``: a few numbers per cell, summed by Spark."""
    parts = fit.select("_x").mapInArrow(lambda b: _projected(b, basis, mean, about), "_part long, _sums array<double>")
    cells = parts.select(F.posexplode("_sums").alias("_cell", "_value")).groupBy("_cell").agg(F.sum("_value").alias("s"))
    k = basis.shape[1]
    out = np.zeros(k * k + k)
    for cell, total in cells.collect():  # k * k + k rows
        out[cell] = total
    return out[: k * k].reshape(k, k), out[k * k :]


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray | list:
    """Per row, the sum of ``(n * x - sums)^2`` in whole numbers; null beyond 64 bits."""
    if len(x) == 0:
        return np.zeros(0, np.int64)
    most = int(np.abs(x).max()) * n + max(map(abs, sums))
    if most * most * x.shape[1] < 2**63:
        shifted = n * x - np.array(sums, np.int64)
        return (shifted * shifted).sum(1)
    out = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in out]


def _whitened(batches, d, n, sums, axes, explained, error) -> Iterator[pa.RecordBatch]:
    mean = np.array([s / n for s in sums])
    k = axes.shape[1]
    for batch in batches:
        x = _matrix(batch.column("_x"), d)
        rows = np.repeat(np.arange(len(x)), k)
        kept = batch.drop_columns(["_x"]).take(pa.array(rows))
        at = ((x - mean) @ axes).ravel()
        deviation = pa.array(exact_deviation(x, n, sums), pa.int64()).take(pa.array(rows))
        size = len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                *kept.columns, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n)), deviation, pa.array(at, from_pandas=True),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)),
            ],
            [*kept.schema.names, *OUT],
        )


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is complete and finite, with its coordinates as whole numbers in ``_x``."""
    c = F.col(f"`{vector}`")
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(c.isNotNull() & good & (F.size(c) > 0)).withColumn("_x", x)


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Coordinates of every row on the leading eigenvectors, scaled to unit variance.

    Each coordinate ``c`` counts as ``x = floor(256 * c)``. The covariance is that
    of the distinct x-vectors, divisor n. Returns, for each row and each component
    up to ``components`` or the number of dimensions, the columns of ``df`` but
    ``vector``, and ``component`` (from 1), ``n`` (vectors fitted), ``deviation``
    (sum of ``(n * x - S)^2``, S the sums per dimension; null beyond 64 bits),
    ``whitened``, ``explained`` (share of the variance) and ``identity_error``
    (largest distance of the whitened fit's covariance from the identity).

    Rows with a null or empty vector, or a null or non-finite entry, go. So do
    vectors of another length than the commonest (the shorter of equals). A
    repeated row is returned as often as it comes and fitted once. A component
    without variance has a null ``whitened`` and an ``explained`` of 0 and does
    not enter ``identity_error``. An empty table gives no rows. Input columns
    with those names, or named ``_x``, give way.
    """
    base = without(df, *OUT, "_x")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name.lower() != vector.lower()]
    schema = ", ".join(
        [*fields, "component int, n long, deviation long, whitened double, explained double, identity_error double"]
    )
    rows = whole_vectors(base, vector)
    fit = write_out(rows.select("_x").distinct())
    common = fit.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    d, n = common
    fit = fit.where(F.size("_x") == d)
    totals = fit.select(F.posexplode("_x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in totals.orderBy("i").collect()]  # one row per dimension
    mean = np.array([s / n for s in sums])

    basis = spectrum(fit, d).basis
    products, moments = projected(fit, basis, mean)
    products = (products - np.outer(moments, moments) / n) / n
    values, turn = np.linalg.eigh((products + products.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(values.sum())
    k = min(components, d)
    axes = basis @ turn[:, :k]
    axes /= np.linalg.norm(axes, axis=0)
    held = values[:k] > d * EPS * max(trace, 0.0)
    axes = np.where(held, axes / np.sqrt(np.where(held, values[:k], 1.0)), np.nan)
    explained = np.where(held, values[:k] / (trace or 1.0), 0.0)

    error = 0.0
    if held.any():
        white = axes[:, held]
        _, moments = projected(fit, white, mean)
        products, _ = projected(fit, white, mean, moments / n)
        error = float(np.abs(products / n - np.eye(white.shape[1])).max())
    kept = [c for c in base.columns if c.lower() != vector.lower()]
    return (
        rows.where(F.size("_x") == d).select(*[F.col(f"`{c}`") for c in kept], "_x")
        .mapInArrow(lambda b: _whitened(b, d, n, sums, axes, explained, error), schema)
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector and component: its whitened coordinate and the figures of the fit."""
    return whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", *OUT)
