"""Embedding whitening by incremental eigendecomposition.

Vectors are scaled to whole numbers first, so equal rows can be told and sums are exact.  The covariance is that of the
distinct vectors.

* **Updates.**  Every partition keeps count, mean, eigenvalues and eigenvectors of its scatter matrix.  A batch of rows is
  centred and reduced to at most d rows of the same scatter (its triangular factor); each of them, and the shift of the
  mean, is a rank-one update: in the eigenbasis the matrix is diagonal plus z z', its new eigenvalues are the roots of
  the secular equation 1 + sum z_i^2 / (d_i - x) = 0, one between every two old ones, and its eigenvectors follow from
  the roots.  Coordinates with no weight are deflated, and equal eigenvalues are first rotated until one of them has
  all the weight.
* **Combining.**  The spectra of partitions are merged sixteen at a time on the executors: each eigenpair of one is a
  rank-one update of the other, and so is the distance of the means.  Only the last spectrum reaches the driver.
* **Refinement.**  One more pass projects the vectors, centred by the exact mean, on the eigenvectors found, and sums the
  projected covariance.  Its eigenvectors rotate the basis to the Rayleigh-Ritz vectors, which are eigenvectors to
  double precision, as the basis spans the whole space.  A last pass measures how far whitened rows are from identity.

The state is d by d, so the method is meant for vectors of up to some hundred entries; its size does not depend on rows.

Defined cases: vectors that are null or empty, or hold entries that are null, not finite or too large for whole numbers
of 62 bits, are dropped; if lengths differ, the most frequent one (of equally frequent ones the longest) stays.
Repeated rows and null ids are rows of their own.  Components are numbered by falling eigenvalue; one whose eigenvalue
is below 1e-12 of the trace has null ``whitened`` and takes no part in ``identity_error``; with a trace of zero,
``explained`` is null too.  A ``deviation`` beyond 63 bits is null.  An empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE, OFFSET, FAN_IN = 64, 1_000_000, 16
_LIMIT = 2.0**62
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots x of 1 + sum weights_i / (poles_i - x) = 0, as (nearest pole, distance from it) of each root.

    Poles rise and differ, weights are positive.  Root i lies between poles i and i + 1, the last within the sum of
    weights above the last pole.  Distances, not roots, are bisected, so those close to a pole keep their digits.
    """
    k = len(poles)
    gaps = np.append(np.diff(poles), weights.sum())
    lower = np.arange(k)

    def value(origin: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return 1 + (weights / ((poles - poles[origin][:, None]) - distance[:, None])).sum(axis=1)

    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        right = (value(lower, gaps / 2) < 0) & (lower < k - 1)
        origin = np.where(right, np.minimum(lower + 1, k - 1), lower)
        near, far = np.zeros(k), np.where(right, -gaps / 2, np.where(lower < k - 1, gaps / 2, gaps))
        for _ in range(1_100):  # ends when no interval can be halved, which takes about 60 rounds
            a, b = np.abs(near), np.abs(far)  # halved by exponent while the ends differ in size, else by value
            middle = np.where((a > 0) & (b > 4 * a), np.sign(far) * np.sqrt(a) * np.sqrt(b), np.where(a > 0, (near + far) / 2, far * 2.0**-32))
            done = (middle == near) | (middle == far) | (np.abs(far - near) <= _EPS * b) | (b < 1e-290)
            if done.all():
                break
            beyond = value(origin, middle) < 0  # the function rises from minus to plus infinity between poles
            farther = np.where(right, ~beyond, beyond)  # the root is farther from its pole than the middle
            near, far = np.where(farther & ~done, middle, near), np.where(~farther & ~done, middle, far)
    return origin, np.where(far == 0, near, (near + far) / 2)


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors (columns) of vectors diag(values) vectors' + row row'."""
    z = vectors.T @ row
    norm = float(np.linalg.norm(z))
    if norm == 0:
        return values, vectors
    size = max(float(np.abs(values).max(initial=0)), norm**2)
    tolerance = 8 * _EPS * size
    values, z, vectors = values.copy(), z.copy(), vectors.copy()
    used = np.abs(z) * norm > tolerance  # what is left out moves no eigenvalue by more than the tolerance
    last = -1
    for i in np.flatnonzero(used):
        if last >= 0 and values[i] - values[last] <= tolerance:  # equal eigenvalues: turn all weight to the upper one
            r = np.hypot(z[i], z[last])
            c, s = z[i] / r, z[last] / r
            vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            z[i], z[last], used[last] = r, 0.0, False
        last = i
    k = np.flatnonzero(used)
    poles, z = values[k], z[k]
    origin, distance = secular_roots(poles, z * z)
    to_root = (poles[origin] - poles[:, None]) + distance  # root j less pole i
    others = poles - poles[:, None]
    np.fill_diagonal(others, 1.0)
    exact = np.sign(z) * np.sqrt(np.abs(np.prod(to_root / others, axis=1)))  # weights for which these roots are exact, so that vectors are orthogonal
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = exact[:, None] / -to_root
    bad = ~np.isfinite(turn).all(axis=0)
    turn[:, bad] = np.eye(len(k))[:, bad]
    turn /= np.linalg.norm(turn, axis=0)
    values[k], vectors[:, k] = poles[origin] + distance, vectors[:, k] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean, and the eigenpairs of the scatter matrix."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.zeros(d), np.eye(d))

    def _absorb(self, n: int, sums: np.ndarray, mean: np.ndarray, rows: np.ndarray) -> None:
        """Add n vectors of the given mean whose scatter is rows' rows."""
        shift = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n, self.sums = self.n + n, self.sums + sums
        for row in (*rows, shift):
            self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def add(self, x: np.ndarray) -> None:
        mean = x[0] + (x - x[0]).mean(axis=0)
        self._absorb(len(x), x.sum(axis=0), mean, np.linalg.qr(x - mean, mode="r"))

    def merge(self, other: Spectrum) -> None:
        self._absorb(other.n, other.sums, other.mean, np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T)


_SPECTRUM = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


def _spectrum_row(part: int, s: Spectrum) -> pa.RecordBatch:
    names = ["part", "n", "sums", "mean", "values", "vectors"]
    cells = [pa.array([part]), pa.array([s.n]), pa.array([s.sums.tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cells + [pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.vectors)], names)


def _spectrum_of(row: dict) -> Spectrum:
    d = len(row["mean"])
    return Spectrum(row["n"], np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(d, d))


def _combined(parts: DataFrame, schema: str, merge: Callable[[list[dict]], pa.RecordBatch]) -> dict | None:
    """Merge the rows (part, ...) sixteen at a time until one is left."""
    parts = stored(parts, "parts")
    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return None
    while top > 0:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part")
        parts = stored(parts.applyInArrow(lambda t: pa.Table.from_batches([merge(t.to_pylist())]), schema), "parts")
        top //= FAN_IN
    return parts.first().asDict()


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part as floor(64 c) + 1,000,000, 64-bit numbers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["embedding"].cast(pa.list_(pa.float64()))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))  # null entries become nan
            fine = np.abs(flat) < _LIMIT
            x = np.where(fine, flat, 0).astype(np.int64) + OFFSET
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~fine)])
            keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            data = x.astype("<i8").tobytes()
            made = [data[8 * (e - n) : 8 * e] if k else None for e, n, k in zip(ends.tolist(), lengths.tolist(), keep.tolist())]
            out = pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), pa.array(made, pa.binary())], ["vec_id", "x"])
            yield out.filter(pa.array(keep))

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


@dataclass
class Whitening:
    """``components``: columns are eigenvectors by falling eigenvalue; ``values``: eigenvalues of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = [s // self.n for s in self.sums]  # x - S/n without the digits lost to large x
        return (x - np.array(whole, np.int64)) - np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])


def _sums_of(fit: DataFrame, d: int, project: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Sums over all rows y of ``fit``, projected: first those of y, then those of y y', as one (k + 1) x k array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((k + 1, k)), None
        for batch in batches:
            if batch.num_rows:
                y = project(_matrix(batch["x"], d))
                total[0] += y.sum(axis=0)
                total[1:] += y.T @ y
                part = batch["part"][0].as_py()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.ravel().tolist()])], ["part", "total"])

    def merge(rows: list[dict]) -> pa.RecordBatch:
        total = np.sum([r["total"] for r in rows], axis=0)
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["part"]]), pa.array([total.tolist()])], ["part", "total"])

    schema = "part long, total array<double>"
    parts = fit.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, schema)
    return np.array(_combined(parts, schema, merge)["total"]).reshape(k + 1, k)


def fit_whitening(fit: DataFrame, d: int, components: int = 16) -> Whitening | None:
    """Fit on the rows (x) of ``fit``, vectors of ``d`` whole numbers; null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, part = Spectrum.empty(d), None
        for batch in batches:
            if batch.num_rows:
                spectrum.add(_matrix(batch["x"], d))
                part = batch["part"][0].as_py()
        if part is not None:
            yield _spectrum_row(part, spectrum)

    def merge(rows: list[dict]) -> pa.RecordBatch:
        first, *rest = map(_spectrum_of, rows)
        for other in rest:
            first.merge(other)
        return _spectrum_row(rows[0]["part"], first)

    parts = fit.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, _SPECTRUM)
    found = _combined(parts, _SPECTRUM, merge)
    if found is None:
        return None
    spectrum = _spectrum_of(found)
    rough = Whitening(spectrum.n, spectrum.sums.tolist(), spectrum.values, spectrum.vectors, 0.0, None)
    total = _sums_of(fit, d, lambda x: rough.centred(x) @ rough.components, d)
    mean = total[0] / rough.n
    values, turn = np.linalg.eigh(total[1:] / rough.n - np.outer(mean, mean))
    vectors = (rough.components @ turn)[:, ::-1]
    vectors /= np.linalg.norm(vectors, axis=0)
    trace = float(np.maximum(values, 0).sum())
    k = min(d, components)
    made = Whitening(rough.n, rough.sums, np.maximum(values[::-1], 0)[:k], vectors[:, :k], trace, None)
    live = int((made.values > 1e-12 * trace).sum())
    if live:
        scaled = made.components[:, :live] / np.sqrt(made.values[:live])
        total = _sums_of(fit, d, lambda x: made.centred(x) @ scaled, live)
        mean = total[0] / made.n
        made.identity_error = float(np.abs(total[1:] / made.n - np.outer(mean, mean) - np.eye(live)).max())
    return made


def _deviations(x: np.ndarray, made: Whitening) -> list[int | None]:
    """Sums of (n x - S)^2, exact: in 64-bit numbers where no row can overflow them, else in Python's."""
    reach = max(made.n * int(np.abs(x).max()) + max(map(abs, made.sums)), 1)
    if reach < 2**62:
        off = x * made.n - np.array(made.sums, np.int64)
        if x.shape[1] * int(np.abs(off).max()) ** 2 < 2**63:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((made.n * v - s) ** 2 for v, s in zip(row, made.sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = stored(whole_numbers(embeddings), "vectors")
    lengths = rows.groupBy(F.octet_length("x").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    rows = rows.where(F.octet_length("x") == lengths.size)
    d = lengths.size // 8
    made = fit_whitening(stored(rows.select("x").distinct(), "distinct"), d, components)
    k = len(made.values)
    live = made.values > 1e-12 * made.trace
    scaled = made.components / np.sqrt(np.where(live, made.values, 1.0))
    explained = (made.values / made.trace).tolist() if made.trace > 0 else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _matrix(batch["x"], d), batch.num_rows
            y = made.centred(x) @ scaled
            cells = [
                pa.array(np.repeat(np.arange(n), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, made.n)),
                pa.array(_deviations(x, made), pa.int64()), pa.array(y.ravel(), mask=np.tile(~live, n)), pa.array(explained * n, pa.float64()), pa.array([made.identity_error] * (n * k), pa.float64()),
            ]
            at = cells[0]
            cells[0], cells[3] = batch["vec_id"].take(at), cells[3].take(at)
            yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in _RESULT.split(", ")])

    return rows.mapInArrow(run, _RESULT)
