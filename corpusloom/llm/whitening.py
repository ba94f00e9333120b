"""Whitening of embeddings: components of the covariance by spectral divide and conquer, applied to every row.

Entries become integers, floor(SCALE * c). The fit list is each distinct integer vector once, found by one aggregation on the packed vector, so
a vector that a third of all rows hold is combined before anything is shuffled. Sums and products of the fit list are
whole numbers: entries are centred on the integer nearest to their mean before they are multiplied, and the rest of the mean comes off exactly, so the covariance
doesn't depend on how rows are spread. Only it, as wide as the vectors, reaches the driver, where polar decompositions
split it into components (spectral.py); mean and components are broadcast with the task that applies them.

Cases: rows whose vector is null or holds null or non-finite entries go. A vector shorter than the table's longest counts as
ending in zeros; an empty one as zeros. Without rows the result is empty. Where the distinct vectors span fewer
directions than components are asked for, the components without variance have a null whitened value (their explained share is 0; null if
nothing varies at all), and identity_error is over the others (null without any). Repeated rows get rows each, equal ids too, null ids as well. deviation
is null where it is beyond a long. Entries beyond 2^63 / SCALE stop there. Where products could be beyond 2^62, covariances are summed in double precision.
Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectral
from .common import discard, materialise

SCALE = 256
COMPONENTS = 4
_MOST = 1 << 62


class Whitening(NamedTuple):
    """What a fit gives: n vectors, the sums of their entries, components as columns by falling variance, total their variance in all."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def scaled(self) -> np.ndarray:
        """Components over the root of their variance, null (nan) where they have none."""
        floor = self.width * np.finfo(float).eps * self.total
        return self.components / np.sqrt(np.where(self.variances > floor, self.variances, np.nan))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has numbers only."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False)))


def integers(column: pa.ListArray) -> list[np.ndarray] | np.ndarray:
    """Whole-number vectors of an Arrow column: one array of rows where all are as long, else one for each."""
    if not len(column):
        return []
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    x = np.where(np.abs(scaled) < 2.0**63, scaled, 0).astype(np.int64)
    x = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.where(scaled < -(2.0**63), np.iinfo(np.int64).min, x))
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() == lengths.max():
        return x.reshape(len(lengths), lengths[0])
    return np.split(x, np.cumsum(lengths)[:-1])


def _square(rows: list[np.ndarray] | np.ndarray, width: int) -> np.ndarray:
    """Rows of one width; zeros end shorter ones."""
    if isinstance(rows, np.ndarray) and rows.shape[1] == width:
        return rows
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector's bytes without the zeros at its end, and its length."""
    for batch in batches:
        rows = integers(batch[0])
        sizes = [len(r) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([np.trim_zeros(r, "b").tobytes() for r in rows], pa.binary()), pa.array(sizes, pa.int64())], ["x", "length"])


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return _square([np.frombuffer(x, dtype=np.int64) for x in batch[0].to_pylist()], width)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each dimension: number of rows, sum (as text: it may be beyond a long), smallest and largest entry."""
    n, total = 0, np.zeros(width, dtype=object)
    low, high = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
    for batch in batches:
        x = _unpacked(batch, width)
        if len(x):
            n += len(x)
            small = np.abs(x.astype(np.float64)).max(initial=0) * len(x) < _MOST
            total += (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array([n] * width, pa.int64()), pa.array([str(s) for s in total]), pa.array(low), pa.array(high)], ["i", "n", "total", "low", "high"])


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray, exact: bool) -> Iterator[pa.RecordBatch]:
    """The sums of products of centred entries of this task: a row for each dimension."""
    width = len(centre)
    total = np.zeros((width, width), dtype=np.int64 if exact else np.float64)
    for batch in batches:
        y = _unpacked(batch, width) - centre
        # products of whole numbers below 2^53 in all are exact in double precision, and faster there
        top = float(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
        total += (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64) if exact and top < 2**53 else y.T @ y
    values = pa.array(total.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), values], ["i", "j", "v"])


def fitted(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct integer vectors of a table, and those vectors (x, packed); no whitening without rows."""
    packed = usable(vectors.select(F.col(vector).alias("embedding")), "embedding").mapInArrow(_packed, "x binary, length long")
    fit = materialise(packed.groupBy("x").agg(F.max("length").alias("length")), "fit")
    width = fit.agg(F.max("length")).first()[0]
    if width is None:
        return None, fit
    each = fit.select("x").mapInArrow(lambda b: _sums(b, width), "i long, n long, total string, low long, high long")
    whole = F.sum(F.col("total").cast("decimal(38,0)")).cast("string")
    stats = sorted(each.groupBy("i").agg(F.sum("n").alias("n"), whole.alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect())  # a row for each dimension
    if not stats:
        return Whitening(fit.count(), [], np.zeros((0, 0)), np.zeros(0), 0.0), fit
    n, sums = stats[0]["n"], [int(r["total"]) for r in stats]
    most = max(max(abs(r["low"]), abs(r["high"])) for r in stats)
    exact = 4 * most * most * n < _MOST
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64) if exact else np.array([s / n for s in sums])
    parts = fit.select("x").mapInArrow(lambda b: _products(b, centre, exact), "i long, j long, v long" if exact else "i long, j long, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # width * width numbers
    if exact:
        left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]  # n times what of the mean the centre lacks
        v = np.zeros((width, width))
        for r in found:
            v[r["i"], r["j"]] = (n * r["v"] - left[r["i"]] * left[r["j"]]) / (n * n)  # whole numbers until the division
    else:
        v = np.zeros((width, width))
        for r in found:
            v[r["i"], r["j"]] = r["v"] / n
    values, axes = spectral.eigen(v, min(components, width))
    k = min(components, width)
    return Whitening(n, sums, axes[:, :k], np.maximum(values[:k], 0), float(np.trace(v))), fit


def _moments(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened values of this task and of their products."""
    scaled, mean = model.scaled(), model.mean
    k = scaled.shape[1]
    total = np.zeros((k, k + 1))
    for batch in batches:
        z = (_unpacked(batch, model.width) - mean) @ scaled
        total += np.hstack([z.T @ z, z.sum(axis=0)[:, None]])
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k + 1)), pa.array(np.tile(np.arange(k + 1), k)), pa.array(total.ravel())], ["i", "j", "v"])


def identity_error(model: Whitening, fit: DataFrame) -> float | None:
    """The largest entry by which the covariance of the fit list's whitened vectors differs from the identity."""
    k = model.components.shape[1]
    rows = fit.select("x").mapInArrow(lambda b: _moments(b, model), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect() if k else []  # k * (k + 1) numbers
    found = np.zeros((k, k + 1))
    for r in rows:
        found[r["i"], r["j"]] = r["v"] / model.n
    off = np.abs(found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k))
    off = off[~np.isnan(off)]
    return float(off.max()) if len(off) else None


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2 of each row, null beyond a long."""
    most = max((abs(s) for s in model.sums), default=0)
    if (model.n * float(np.abs(x.astype(np.float64)).max(initial=0)) + most) ** 2 * max(1, model.width) < _MOST:
        return ((model.n * x - np.array(model.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    found = ((x.astype(object) * model.n - np.array(model.sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def whitened(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (an array) of every row with numbers only; vectors longer than the model's are cut."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, mean = model.scaled(), model.mean
        k = scaled.shape[1]
        for batch in batches:
            found = integers(batch[1])
            x = _square([r[: model.width] for r in found], model.width) if len(found) else np.zeros((0, model.width), dtype=np.int64)
            z = ((x - mean) @ scaled).ravel()
            values = pa.array(z, mask=np.isnan(z))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(deviations(x, model), pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["vec_id", "deviation", "whitened"])

    rows_in = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    return usable(rows_in, "embedding").mapInArrow(rows, "vec_id long, deviation long, whitened array<double>")


def components(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", number: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    model, fit = fitted(vectors, vector, number)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(model, fit)
    discard(fit)
    shares = [float(v / model.total) if model.total else None for v in model.variances]
    rows = whitened(vectors, model, id_column, vector).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    share = F.get(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("i"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
