"""Whitening of embeddings by shifted Cholesky QR (Fukaya and others, 2020), one distributed pass per Gram matrix.

The centred rows X are never held together. A pass works out the Gram matrix of what the passes before made of X, its
Cholesky factor R comes to the driver's d by d world, and the next pass divides by it through triangular solves, so that
X = Q R with Q ever closer to orthonormal columns. The first Gram matrix is shifted, as rounding may have left it without a
Cholesky factor; the second is factored with pivots, which leaves out directions without variance. The composed R
holds all of X's covariance at full precision, and its singular value decomposition gives the components.

Entries become whole numbers, so sums are exact, and a row is centred by whole numbers first: x - S // n, less the rest of
S / n. The large common offset never meets a square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.session import written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries from here on take their vector out: the whole numbers would no longer be exact as doubles.
TOO_LARGE = float(1 << 42)
#: Numbers in a block of rows that a task works on at a time.
BLOCK = 1 << 18
#: A Gram matrix is this close to the identity once its columns are orthonormal.
ORTHONORMAL = 1e-12
MOST_PASSES = 8
#: Of the shifted factor's columns, those with less than this of a unit length left are without variance.
LEAST_PIVOT = 1e-10
#: Tasks' partial sums are added up in this many groups for each row of a Gram matrix, then over these.
FAN = 64


def _whole(scale: int, offset: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = sizes > 0
            fits = np.abs(values) < TOO_LARGE
            good[row[~fits]] = False
            x = np.floor(scale * values[good[row]]).astype(np.int64) + offset
            ends = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").filter(pa.array(good)),
                    pa.array(sizes[good].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x)),
                ],
                ["vec_id", "size", "x"],
            )

    return whole


def whole_vectors(
    vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """``vec_id``, ``size`` and ``x``, the entries as whole numbers floor(scale * entry) + offset.

    Left out are vectors that are null or empty, or hold an entry that is null, not finite or of 2^42 or more.
    """
    picked = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")
    )
    return picked.mapInArrow(_whole(scale, offset), "vec_id long, size int, x array<long>")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK // d)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, d)


def _sums(d: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, d):
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
        total = [Decimal((int(h) << 32) + int(lo)) for h, lo in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d, dtype=np.int32)), pa.array(total, pa.decimal128(38, 0))], ["place", "total"]
        )

    return sums


@dataclass(frozen=True)
class Centre:
    """The mean of ``n`` vectors of whole numbers: ``base`` and ``rest`` / ``n`` make it up exactly."""

    n: int
    base: np.ndarray
    rest: tuple[int, ...]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), tuple(s % n for s in sums))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sums over dimensions of (n * x - S) ** 2, as n * x - S is n * y - rest with y = x - base."""
        y = x - self.base
        most = int(np.abs(y).max(initial=0)) + 1
        if most * most * y.shape[1] < 1 << 62 and most * y.shape[1] < 1 << 31 and self.n < 1 << 62:
            low = np.array([r & 0x7FFFFFFF for r in self.rest], np.int64)
            high = np.array([r >> 31 for r in self.rest], np.int64)
            n, own = self.n, sum(r * r for r in self.rest)
            parts = zip((y * y).sum(axis=1).tolist(), (y @ high).tolist(), (y @ low).tolist(), strict=True)
            return [n * n * squares - 2 * n * ((h << 31) + lo) + own for squares, h, lo in parts]
        t = y.astype(object) * self.n - np.array(self.rest, object)
        return [sum(v * v for v in row) for row in t.tolist()]


def divided(rows: np.ndarray, r: np.ndarray, width: int = 64) -> np.ndarray:
    """Rows times the inverse of an upper triangle, by substitution over blocks of columns."""
    out = np.empty_like(rows)
    for start in range(0, r.shape[0], width):
        stop = min(start + width, r.shape[0])
        out[:, start:stop] = rows[:, start:stop] - out[:, :start] @ r[:start, start:stop]
        for j in range(start, stop):
            out[:, j] = (out[:, j] - out[:, start:j] @ r[start:j, j]) / r[j, j]
    return out


def pivoted_cholesky(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns with a pivot of at least ``least``, in pivot order, and R with ``gram`` = R' R up to the others."""
    rest, kept, rows = gram.copy(), [], []
    for _ in range(len(gram)):
        pivots = rest.diagonal().copy()
        pivots[kept] = -np.inf
        at = int(pivots.argmax())
        if pivots[at] < least:
            break
        row = rest[at] / np.sqrt(pivots[at])
        row[kept] = 0.0
        rest -= np.outer(row, row)
        kept.append(at)
        rows.append(row)
    return np.array(kept, np.intp), np.array(rows).reshape(len(rows), len(gram))


@dataclass(frozen=True)
class Step:
    """A pass's factor: the columns it keeps, and the upper triangle to divide them by."""

    columns: np.ndarray
    r: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return divided(rows[:, self.columns], self.r)


def _partial_gram(d: int, made: Callable[[np.ndarray], np.ndarray]):
    """A task's own Gram matrix of what ``made`` makes of its rows, one row of it each."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, d):
            rows = made(x)
            part = rows.T @ rows
            total = part if total is None else total + part
        if total is not None:
            part = np.full(len(total), TaskContext.get().partitionId() % FAN, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(part), pa.array(total.tolist())],
                ["place", "part", "row"],
            )

    return gram


def _added(table: pa.Table) -> pa.Table:
    rows = np.array(table["row"].combine_chunks().flatten()).reshape(table.num_rows, -1)
    return table.slice(0, 1).set_column(
        table.schema.get_field_index("row"), "row", pa.array([rows.sum(axis=0).tolist()])
    )


def _gram(whole: DataFrame, d: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix over all rows. Only its own few rows come to the driver."""
    schema = "place int, part int, row array<double>"
    parts = whole.select("x").mapInArrow(_partial_gram(d, made), schema)
    rows = parts.groupBy("place", "part").applyInArrow(_added, schema).groupBy("place").applyInArrow(_added, schema)
    return np.array([row.row for row in sorted(rows.collect(), key=lambda row: row.place)])


def _composed(centre: Centre, steps: list[Step]) -> Callable[[np.ndarray], np.ndarray]:
    def made(x: np.ndarray) -> np.ndarray:
        rows = centre.centred(x)
        for step in steps:
            rows = step(rows)
        return rows

    return made


@dataclass(frozen=True)
class Whitening:
    """``components`` in columns, with the ``variance`` of each and the ``total`` variance."""

    centre: Centre
    components: np.ndarray
    variance: np.ndarray
    total: float
    passes: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.variance)


def fit(whole: DataFrame, d: int, n: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``n`` vectors ``x`` of ``d`` whole numbers, as many components as have variance at most.

    Each pass hands d by d numbers a task to the sums and d by d numbers to the driver, whatever the number of rows.
    """
    totals = whole.select("x").mapInArrow(_sums(d), "place int, total decimal(38,0)")
    sums = {row.place: int(row.total) for row in totals.groupBy("place").agg(F.sum("total").alias("total")).collect()}
    centre = Centre.of(n, [sums[i] for i in range(d)])
    steps: list[Step] = []
    r = np.eye(d)
    total = 0.0
    for passes in range(1, MOST_PASSES + 1):
        gram = _gram(whole, d, _composed(centre, steps))
        if passes == 1:
            total = float(np.trace(gram))
            if not total:
                return Whitening(centre, np.zeros((d, 0)), np.zeros(0), 0.0, passes)
            # the bound of rounding errors of a Gram matrix summed in blocks
            shift = 11 * (BLOCK + d * (d + 1)) * np.finfo(float).eps / 2 * total
            columns, factor = np.arange(d), np.linalg.cholesky(gram + shift * np.eye(d)).T
        elif passes > 2 and np.abs(gram - np.eye(len(gram))).max() <= ORTHONORMAL:
            break
        else:
            columns, factor = pivoted_cholesky(gram, LEAST_PIVOT * gram.diagonal().max())
        steps.append(Step(columns, factor[:, columns]))
        r = factor @ r
    _, singular, rows = np.linalg.svd(r, full_matrices=False)
    found = min(components, len(singular))
    return Whitening(centre, rows[:found].T, singular[:found] ** 2 / n, total / n, passes)


def identity_error(whole: DataFrame, d: int, whitening: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, by one more pass over all rows."""

    def with_one(x: np.ndarray) -> np.ndarray:
        rows = whitening(x)
        return np.hstack([rows, np.ones((len(rows), 1))])

    moments = _gram(whole, d, with_one) / whitening.centre.n
    mean = moments[-1, :-1]
    return float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def _rows_out(d: int, whitening: Whitening, explained: np.ndarray, error: float):
    k, n = len(explained), whitening.centre.n
    most = 10**38 - 1

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, d):
            rows = len(x)
            deviations = [Decimal(v) if v <= most else None for v in whitening.centre.deviations(x)]
            repeated = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(repeated),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations, pa.decimal128(38, 0)).take(repeated),
                    pa.array(whitening(x).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return out


def whitened(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: ``vec_id``, ``component`` (from 1 by falling variance), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Reads ``vec_id`` and the embedding only, other columns stay out. Vectors that are null or empty, or hold an entry that is
    null, not finite or of 2^42 or more, take no part, nor do those of another length than the most common one (of two as
    common ones, the longer). Repeated rows count and come back each, a null vec_id stays null. Components of one variance
    (ties) are any orthonormal ones of their space, the same for all rows. Directions without variance have no
    component, so equal vectors, one vector or an empty table give an empty result. ``deviation`` is decimal, as it
    outgrows a long beyond some million rows; beyond 38 digits it is null.

    The vectors are written once as whole numbers; each pass reads them and shuffles d by d numbers a task.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    stored = written(whole_vectors(vectors, embedding))
    size = stored.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    d, n = size["size"], size["count"]
    whole = stored.where(F.col("size") == d)
    model = fit(whole, d, n, components)
    if not len(model.variance):
        return spark.createDataFrame([], schema)
    out = _rows_out(d, model, model.variance / model.total, identity_error(whole, d, model))
    return whole.select("vec_id", "x").mapInArrow(out, schema)
