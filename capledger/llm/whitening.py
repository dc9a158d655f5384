"""Whitening of embeddings by incremental eigendecomposition.

A task keeps the count, the mean and the eigendecomposition of the scatter of the vectors it
has read. A batch of vectors, centred at its own mean, is first turned by QR into at most as
many rows as there are dimensions, with the same scatter; each row, and the step between the
two means, is then a rank-one update. An update solves the secular equation of all
eigenvalues at once and deflates what does not take part: components of the row that vanish, and
equal eigenvalues. Spectra of tasks are combined the same way, a few at a time, in a tree of Spark
groups. The basis that comes out is refined by one Rayleigh-Ritz step: all vectors, centred at the exact
mean, are projected on it, and the small matrix of their products is decomposed.

What a task, a group or the driver holds depends on the number of dimensions, not of vectors.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.sources.scratch import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN_IN = 8
BATCH = 4096
#: Entries beyond it, some 10^15, would not be exact doubles; they count as this.
LARGEST = 1 << 50
#: Eigenvalues below this share of the trace are rounding, and have no component.
LEAST_SHARE = 1e-13
_EPS = np.finfo(float).eps
_SPECTRUM = "part int, n long, mean binary, values binary, vectors binary"


@dataclass
class Spectrum:
    """Count, mean and the eigendecomposition (falling order does not matter) of the scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))


def _secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) for rising, distinct d: one behind each pole.

    Each is given as (pole it is measured from, distance), so that differences with the
    poles lose no digits. A step fits the sum by its two nearest poles, which meets the
    root from both sides; where a step leaves the bracket the bracket is halved.
    """
    k = len(d)
    last = z2.sum()
    upper = np.r_[d[1:], d[-1] + last]
    middle = (upper - d) / 2
    at_middle = 1 + (z2 / ((d - d[:, None]) - middle[:, None])).sum(1)
    origin = np.where((at_middle >= 0) | (np.arange(k) == k - 1), np.arange(k), np.arange(k) + 1)
    poles = d - d[origin][:, None]  # of each root, as seen from its origin
    low = np.where(origin == np.arange(k), np.where(at_middle >= 0, 0.0, middle), -middle)
    high = np.where(origin == np.arange(k), np.where(at_middle >= 0, middle, last), 0.0)
    x = (low + high) / 2
    left, right = poles[np.arange(k), np.arange(k)], np.r_[poles[np.arange(k - 1), np.arange(1, k)], np.inf]
    below = np.arange(k) <= np.arange(k)[:, None]
    for _ in range(80):
        gap = poles - x[:, None]
        term = z2 / gap
        f = 1 + term.sum(1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        if np.all((np.abs(f) <= 8 * _EPS * (1 + np.abs(term).sum(1))) | (high - low <= 2 * _EPS * np.abs(x))):
            break
        slope = term / gap
        a, b = (slope * below).sum(1), (slope * ~below).sum(1)
        # f near x as c + s / (left - x) + t / (right - x), with the slopes of both halves.
        dl, dr = left - x, right - x
        s, t = a * dl * dl, np.where(np.isinf(dr), 0.0, b * np.where(np.isinf(dr), 0.0, dr) ** 2)
        c = f - a * dl - np.where(np.isinf(dr), 0.0, b * np.where(np.isinf(dr), 0.0, dr))
        # c (l - y)(r - y) + s (r - y) + t (l - y) = 0 in y = step from x
        r = np.where(np.isinf(dr), 0.0, dr)
        qa, qb, qc = c, -(c * (dl + r) + s + t), c * dl * r + s * r + t * dl
        qa, qb, qc = np.where(np.isinf(dr), 0.0, qa), np.where(np.isinf(dr), -c, qb), np.where(np.isinf(dr), c * dl + s, qc)
        root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
        q = -(qb + np.where(qb >= 0, root, -root)) / 2
        first, second = qc / q, q / qa
        y = np.where((x + first > low) & (x + first < high), x + first, x + second)
        x = np.where((y > low) & (y < high), y, (low + high) / 2)
    return origin, x


def _update(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigendecomposition of ``vectors diag(values) vectors' + row row'``."""
    order = np.argsort(values, kind="stable")
    d, q = values[order], vectors[:, order]
    z = row @ q
    size = max(np.abs(d).max(initial=0.0), z @ z)
    if size == 0:
        return d, q
    small = 8 * _EPS * size
    # Equal eigenvalues: turn their plane so that only one of them takes part.
    for i in np.flatnonzero(np.diff(d) <= small):
        r = np.hypot(z[i], z[i + 1])
        if r > 0:
            c, s = z[i + 1] / r, z[i] / r
            z[i], z[i + 1] = 0.0, r
            q[:, [i, i + 1]] = np.c_[c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]]
    part = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > small)
    if not len(part):
        return d, q
    dk, zk = d[part], z[part]
    close = np.r_[False, np.diff(dk) <= 0]
    if close.any():
        dk = np.maximum.accumulate(dk + np.arange(len(dk)) * _EPS * size)
    origin, x = _secular_roots(dk, zk * zk)
    gap = (dk - dk[origin][:, None]) - x[:, None]  # [root, pole]: pole - root
    # The row for which these roots are exact keeps the new vectors orthogonal.
    between = dk[:, None] - dk  # [pole, other]
    np.fill_diagonal(between, 1.0)
    ratio = -gap.T / between  # [pole, root] = (root - pole) / (pole_of_root - pole), the sign below
    ratio[np.arange(len(dk)), np.arange(len(dk))] = -gap[np.arange(len(dk)), np.arange(len(dk))]
    off = ~np.eye(len(dk), dtype=bool)
    ratio[off] *= -1
    exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), zk)
    turned = exact / gap
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    values, vectors = d.copy(), q.copy()
    values[part] = dk[origin] + x
    vectors[:, part] = q[:, part] @ turned.T
    return values, vectors


def with_rows(s: Spectrum, rows: np.ndarray, n: int, mean: np.ndarray) -> Spectrum:
    """``s`` and ``n`` more vectors with that mean, whose scatter is that of ``rows``."""
    if not n:
        return s
    values, vectors = s.values, s.vectors
    with warnings.catch_warnings(), np.errstate(all="ignore"):
        for row in rows:
            if row.any():
                values, vectors = _update(values, vectors, row)
        if s.n:
            values, vectors = _update(values, vectors, (mean - s.mean) * np.sqrt(s.n / (s.n + n) * n))
    # Rounding of many turns adds up: back to right angles.
    q, r = np.linalg.qr(vectors)
    return Spectrum(s.n + n, s.mean + (mean - s.mean) * (n / (s.n + n)), np.maximum(values, 0), q * np.sign(np.diag(r)))


def with_vectors(s: Spectrum, x: np.ndarray) -> Spectrum:
    """``s`` and the rows of ``x``."""
    mean = x.mean(0)
    rows = x - mean
    return with_rows(s, np.linalg.qr(rows, mode="r") if len(x) > x.shape[1] else rows, len(x), mean)


def combined(s: Spectrum, t: Spectrum) -> Spectrum:
    """The spectrum of both: that of ``t`` is taken in component by component."""
    return with_rows(s, (t.vectors * np.sqrt(t.values)).T, t.n, t.mean)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(part: int, s: Spectrum) -> list:
    return [part, s.n, s.mean.tobytes(), s.values.tobytes(), s.vectors.tobytes()]


def _unpacked(n: int, mean: bytes, values: bytes, vectors: bytes) -> Spectrum:
    m = np.frombuffer(mean)
    return Spectrum(n, m, np.frombuffer(values), np.frombuffer(vectors).reshape(len(m), len(m)))


def _of_task(size: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum.empty(size)
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_matrix(batch.column("x"), size).astype(float))
            if sum(map(len, held)) >= batch_rows:
                s, held = with_vectors(s, np.concatenate(held)), []
        if held and sum(map(len, held)):
            s = with_vectors(s, np.concatenate(held))
        if s.n:
            at = abs(hash((s.n, s.mean.tobytes()))) % (1 << 31)
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "n", "mean", "values", "vectors"), _packed(at, s), strict=True))],
                                             schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())]))

    return run


def _of_group(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("mean")
    spectra = [_unpacked(r.n, r["mean"], r["values"], r.vectors) for _, r in frame.iterrows()]
    return pd.DataFrame([_packed(0, functools.reduce(combined, spectra))], columns=["part", "n", "mean", "values", "vectors"])


def spectrum_of(vectors: DataFrame, size: int, *, fan_in: int = FAN_IN, batch_rows: int = BATCH) -> Spectrum:
    """The spectrum of the column ``x`` of ``vectors``, lists of ``size`` numbers, one row for each task at first."""
    parts = stored(vectors.select("x").mapInArrow(_of_task(size, batch_rows), _SPECTRUM), "spectra")
    while (count := parts.count()) > 1:
        groups = -(-count // fan_in)
        place = F.row_number().over(_window()) % groups
        parts = stored(parts.withColumn("part", place.cast("int")).groupBy("part").applyInPandas(_of_group, _SPECTRUM), "spectra")
    row = parts.first()
    return _unpacked(row["n"], row["mean"], row["values"], row["vectors"]) if row else Spectrum.empty(size)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("part", "mean")


def _projected_products(mean_of: tuple[int, np.ndarray], basis: np.ndarray):
    """The upper triangle of the products of all centred vectors in ``basis``, one entry a row."""
    n, total = mean_of
    size = len(total)
    i, j = np.triu_indices(basis.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            y = centred(_matrix(batch.column("x"), size), n, total) @ basis
            sums += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], names=["i", "j", "v"])

    return run


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``x`` less the mean ``total / n``: whole numbers first, so that nothing is lost when values are large and alike."""
    base = np.array([int(t) // n for t in total], np.int64)
    rest = np.array([(int(t) - int(b) * n) / n for t, b in zip(total, base, strict=True)])
    return (x - base).astype(float) - rest


def _covariance(vectors: DataFrame, n: int, total: np.ndarray, basis: np.ndarray) -> np.ndarray:
    entries = vectors.select("x").mapInArrow(_projected_products((n, total), basis), "i long, j long, v double")
    out = np.zeros((basis.shape[1],) * 2)
    for i, j, v in entries.groupBy("i", "j").agg(F.sum("v")).collect():  # as many as dimensions squared
        out[i, j] = out[j, i] = v / n
    return out


@dataclass
class Whitening:
    n: int
    total: np.ndarray  # exact sums of each dimension, whole numbers
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column for each value
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): x = floor(scale * c) + shift of each entry c; vectors that are NULL, empty or hold NULL or
    non-finite entries are left out, as are those of another length than most have (of equally frequent lengths the longest
    stays). Whole numbers are cut at ``LARGEST``."""
    c = F.col("c").cast("array<double>")
    usable = embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    length = usable.groupBy(F.size("c").alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("s", F.struct("n", "s"))).first()[0]
    whole = F.transform(c, lambda e: F.greatest(F.least(F.floor(F.greatest(F.least(e * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))), F.lit(LARGEST)), F.lit(-LARGEST)) + shift)
    return usable.where(F.size("c") == F.lit(length)).select("id", whole.alias("x"))


def fit_whitening(vectors: DataFrame, components: int | None = COMPONENTS, **options) -> Whitening | None:
    """Mean and leading components of the column ``x``; None where there is no vector.

    Components whose eigenvalue is rounding of the trace are left out: n equal vectors have none.
    """
    sums = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    if not sums:
        return None
    n, total = sums[0]["n"], np.array([int(r["s"]) for r in sums], object)
    first = spectrum_of(vectors, len(total), **options)
    basis, r = np.linalg.qr(first.vectors[:, np.argsort(-first.values)])
    ritz = _covariance(vectors, n, total, basis)
    values, turned = np.linalg.eigh(ritz)
    falling = np.argsort(-values, kind="stable")
    trace = float(np.trace(ritz))
    taken = [i for i in falling if values[i] > trace * LEAST_SHARE][:components]
    return Whitening(n, total, values[taken], (basis @ turned)[:, taken], trace)


def whitened(vectors: DataFrame, w: Whitening) -> DataFrame:
    """(id, n, deviation, scores) of each vector: scores are its whitened components, deviation is the sum of
    (n x - S)^2 over all dimensions, exact, NULL where it is beyond a long."""
    n, total, scaled = w.n, w.total, w.scaled
    size, k = len(total), scaled.shape[1]
    largest = max(abs(int(t)) for t in total) + n * (LARGEST + SHIFT)

    def deviation(x: np.ndarray) -> list:
        worst = n * int(np.abs(x - np.array([int(t) // n for t in total])).max(initial=0) + 1)
        if worst * worst * size < 1 << 63 and largest < 1 << 63:
            diff = n * x - total.astype(np.int64)
            return (diff * diff).sum(1).tolist()
        exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, total, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            y = centred(x, n, total) @ scaled
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n] * len(x), pa.int64()), pa.array(deviation(x), pa.int64()), scores],
                                             names=["id", "n", "deviation", "scores"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "x").mapInArrow(run, f"id {kind}, n long, deviation long, scores array<double>")


def identity_error(scores: DataFrame, k: int) -> float:
    """Largest entry by which the covariance of ``scores`` differs from the identity."""
    if not k:
        return 0.0
    at = [F.get("scores", F.lit(i)) for i in range(k)]
    means = scores.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)]).first()
    row = scores.agg(*[F.avg((at[i] - means[i]) * (at[j] - means[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whitened_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS, **options) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    See ``whole_vectors`` for what is usable. Repeated rows and NULL ids count like others; an empty table, or one
    whose vectors are all equal, has no component and so no row. With fewer dimensions or a lower rank
    there are fewer components.
    """
    vectors = stored(whole_vectors(embeddings, id_col, vector_col), "whole-vectors")
    w = fit_whitening(vectors, components, **options)
    if w is None or not len(w.values):
        kind = vectors.schema["id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    scores = stored(whitened(vectors, w), "scores")
    error = identity_error(scores, len(w.values))
    shares = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
    each = scores.select("id", "n", "deviation", F.posexplode("scores").alias("at", "whitened"))
    return each.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
