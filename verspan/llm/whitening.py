"""Embedding whitening: principal components by a randomised range finder.

Entries become integers x = floor(SCALE * c). The fit is over the distinct vectors: their
number n, sums S by dimension and covariance V (divisor n, each row centred as
(n * x - S) / n before it is multiplied).

V is never formed. A random basis of k + ``OVERSAMPLE`` directions is multiplied by V in
one pass over all centred rows, made orthonormal and multiplied again (``POWER`` repeated
passes); every pass gives Rayleigh-Ritz values and vectors and their residuals
|V u - e u|. Once the residuals of the first k are below ``TOLERANCE`` of their values the
search ends; if they still fail after the last pass, the basis is expanded to the full
dimension, where Rayleigh-Ritz is exact. A pass sends each task's sums, one matrix of
dimension by basis, added up by cell in Spark; only that matrix reaches the driver.

Defined cases: vectors that are null or hold null or non-finite entries are dropped;
an entry beyond a long's range is the nearest long; vectors of each length are a space of
their own, fitted apart; components whose value is below rounding (fewer distinct vectors
than components, constant dimensions, one vector only) do not exist, so there are fewer
rows; an empty vector has none; equal eigenvalues give any basis of their space, the same
for all rows; repeated rows count once in the fit and are returned each; a null id stays
null; ``deviation`` is null where no long holds it; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import scratch, table

SCALE, K = 256, 4
OVERSAMPLE, POWER, TOLERANCE, SEED = 8, 3, 1e-12, 11
OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = 1 << 63


@dataclass
class Moments:
    """What is known of the fit list of one length: exact integers."""

    n: int
    sums: list[int]
    largest: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they and their squares' sum must fit, else as Python integers."""
        d = len(self.sums)
        if d * (2 * self.n * self.largest) ** 2 < _LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


@dataclass
class Whitening:
    """Components as columns, by falling value, scaled to unit variance by ``apply``."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ (self.vectors / np.sqrt(self.values))


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): rows that take part, entries floor(scale * c) as longs."""
    v = F.col(vec_col)
    whole = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cells(total: np.ndarray, names: tuple[str, str, str]) -> pa.RecordBatch:
    i, j = np.indices(total.shape, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], list(names))


def _summed(rows: DataFrame, f, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of f(x), a matrix of a fixed shape: by task, then by cell in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b.column("x")))
        yield _cells(total, ("i", "j", "v"))

    cells = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape)
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out


def _moments(rows: DataFrame, d: int) -> Moments:
    """Exact sums: a batch's as longs where they fit, as decimals between tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, [0] * d, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            top = max(int(x.max()), -int(x.min()))
            own = x.sum(0) if top * len(x) < _LONG else x.astype(object).sum(0)
            n, sums, most = n + len(x), [s + int(o) for s, o in zip(sums, own)], max(most, top)
        dims = [(i, s) for i, s in enumerate(sums)] + [(-1, n), (-2, most)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in dims], pa.int32()), pa.array([str(s) for _, s in dims])], ["i", "s"])

    told = rows.mapInArrow(run, "i int, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
    found = {r["i"]: r for r in told.groupBy("i").agg(F.sum("s").alias("s"), F.max("s").alias("m")).collect()}  # a row for each dimension
    return Moments(int(found[-1]["s"]), [int(found[i]["s"]) for i in range(d)], int(found[-2]["m"]))


def _ritz(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in an orthonormal basis with its image under V: first k values, vectors and residuals."""
    t = basis.T @ image
    values, turn = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(-values)[:k]
    values, turn = values[order], turn[:, order]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def fit(distinct: DataFrame, d: int, k: int = K, tolerance: float = TOLERANCE) -> Whitening | None:
    """The first k components of distinct integer vectors (x) of length d, fewer if V has fewer; None without rows."""
    m = _moments(distinct, d) if d else None
    if not m or not m.n:
        return None
    rng, k = np.random.default_rng(SEED), min(k, d)

    def image(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """V times the basis, and V's trace in the last row's first cell."""
        def f(x: np.ndarray) -> np.ndarray:
            z = m.centred(x)
            out = np.zeros((d + 1, basis.shape[1]))
            out[:d], out[d, 0] = z.T @ (z @ basis), np.einsum("ij,ij->", z, z)
            return out

        total = _summed(distinct, f, (d + 1, basis.shape[1])) / m.n
        return total[:d], float(total[d, 0])

    basis = np.linalg.qr(rng.standard_normal((d, min(d, k + OVERSAMPLE))))[0]
    for power in range(POWER + 1):
        y, trace = image(basis)
        values, vectors, residuals = _ritz(basis, y, k)
        if basis.shape[1] == d or (residuals <= tolerance * values).all():
            break
        # the last time, what was found is kept and the rest of the space is added
        wide = np.hstack([y, rng.standard_normal((d, d - y.shape[1]))]) if power == POWER else y
        basis = np.linalg.qr(wide)[0]
    else:
        y, trace = image(basis)
        values, vectors, residuals = _ritz(basis, y, k)
    real = values > max(d, 16) * np.finfo(float).eps * trace
    if trace <= 0 or not real.any():
        return None
    w = Whitening(m, vectors[:, real], values[real], trace)
    c = len(w.values)

    def squares(x: np.ndarray) -> np.ndarray:
        y = w.apply(x)
        return np.vstack([y.T @ y, y.sum(0)])

    total = _summed(distinct, squares, (c + 1, c)) / m.n
    w.identity_error = float(np.abs(total[:c] - np.outer(total[c], total[c]) - np.eye(c)).max())
    return w


def _applied(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(w.values)
        share = w.values / w.trace
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            far = w.moments.deviations(x)
            far = [v if v < _LONG else None for v in (far * far).sum(1).tolist()]
            rows = np.repeat(np.arange(len(x)), c)
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), w.moments.n)),
                pa.array(far, pa.int64()).take(pa.array(rows)), pa.array(w.apply(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(rows), w.identity_error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, scale).withColumn("id", F.col("id").cast("long"))
    out = spark.createDataFrame([], OUT)
    with scratch(spark) as keep:
        distinct = keep(rows.select("x").distinct(), "fit")
        for r in distinct.select(F.size("x").alias("d")).distinct().orderBy("d").collect():  # one row for each length of vectors
            w = fit(distinct.where(F.size("x") == r["d"]), r["d"], k, tolerance)
            if w:
                out = out.union(rows.where(F.size("x") == r["d"]).mapInArrow(_applied(w), OUT))
    return out.withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
