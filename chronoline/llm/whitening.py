"""Whitening of embeddings by a randomised range finder.

Entries become whole numbers, ``x = floor(scale * c)``; every distinct x vector counts once in the
fit. A Gaussian block of ``components + oversample`` columns is multiplied by the covariance again
and again; each power pass reads all centred rows, and its products are summed by Spark. After a
pass Rayleigh-Ritz on the block gives eigenpairs and their residuals. When the residuals reach the
rounding of the covariance the block is done; when they can't within ``passes``, or shrink too slowly
to, the block is expanded to the full dimension, for which one pass is exact.

Defined results. Rows whose vector is null or holds a null or a non-finite entry are dropped. Shorter
vectors are padded with zeros to the longest length; empty vectors beside no others have no
components and so no rows. Vectors of fewer than ``components`` entries have that many components.
A component without variance (fewer distinct vectors than components, or repeated rows alone) has
explained 0 and a null whitened value, and isn't part of identity_error. Entries whose multiple
passes the range of a long saturate; a deviation that passes it is null. Repeated rows and null
vec_ids are returned as they are; an empty table gives an empty result; other columns are ignored.

What reaches the driver is of the size of a covariance: the vectors' length squared at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import sized, table

SCHEMA = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
#: a residual counts as rounding if it is at most so many units in the last place of the largest eigenvalue
ULPS = 64
MOST_LONG = (1 << 63) - 1


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    passes: int  # power passes over all rows
    full: bool  # whether the block was expanded to the full dimension

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scale(self) -> np.ndarray:
        """1/sqrt(e) for components with variance, else NaN."""
        some = self.values > len(self.sums) * ULPS * np.finfo(float).eps * self.trace
        return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), np.nan)


def whole(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows whose entries are all finite, and the length of x."""
    c = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    width = rows.agg(F.max(F.size("c"))).first()[0] or 0
    # an entry is at most the largest double, so its multiple may be infinite; floor saturates both
    x = F.transform("c", lambda v: F.floor(v * float(scale)))
    return rows.select("vec_id", F.when(F.size("c") == width, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("c")))).alias("x")), width


def blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def summed(rows: DataFrame, product: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix that ``product`` gives for a block of them. Each task adds up its
    own blocks; Spark adds up the tasks' entries."""

    def part(batches):
        total = None
        for x in blocks(batches):
            total = product(x) if total is None else total + product(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(shape[0] * shape[1])
    for at, v in rows.mapInArrow(part, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[at] = v
    return out.reshape(shape)


def fit(distinct: DataFrame, width: int, components: int = 4, oversample: int = 12, passes: int = 6, seed: int = 13) -> Fit | None:
    """Eigenpairs of the covariance of ``distinct`` (x), None if it has no rows."""
    sums = {i: (n, s) for i, n, s in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)"))).collect()}
    if not sums:
        return None
    n, total = sums[0][0], [int(sums[i][1]) for i in range(width)]
    mean = np.array([s / n for s in total])

    def power(block):
        """The covariance times ``block``, and the trace, in one pass."""

        def product(x):
            y = x - mean
            return np.vstack([y.T @ (y @ block), np.full((1, block.shape[1]), np.einsum("ij,ij->", y, y))])

        out = summed(distinct, product, (width + 1, block.shape[1])) / n
        return out[:-1], float(out[-1, 0])

    k, size = min(components, width), min(components + oversample, width)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0] if size < width else np.eye(width)
    before = np.inf
    for done in range(1, passes + 1):
        image, trace = power(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = block @ turn[:, :k]
        left = np.linalg.norm(image @ turn[:, :k] - top * values[:k], axis=0).max()
        enough = ULPS * np.finfo(float).eps * max(abs(values[0]), np.finfo(float).tiny)
        if size == width or left <= enough:
            return Fit(n, total, values[:k], top, trace, done, size == width)
        # residuals fall by about the same factor in each pass
        rate = left / before
        if done > 1 and (rate >= 1 or np.log(enough / left) / np.log(rate) > passes - done):
            break
        before, block = left, np.linalg.qr(image)[0]
    image, trace = power(np.eye(width))
    values, vectors = np.linalg.eigh((image + image.T) / 2)
    return Fit(n, total, values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy(), trace, done + 1, True)


def identity_error(distinct: DataFrame, found: Fit) -> float:
    """The largest entry, taken positive, of the covariance of the whitened fit list less the identity."""
    some = np.isfinite(found.scale)
    turn, mean, k = (found.vectors * found.scale)[:, some], found.mean, int(some.sum())
    if not k:
        return 0.0
    centre = summed(distinct, lambda x: ((x - mean) @ turn).sum(0, keepdims=True), (1, k)) / found.n

    def product(x):
        w = (x - mean) @ turn - centre
        return w.T @ w

    return float(np.abs(summed(distinct, product, (k, k)) / found.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n*x - S)^2, exact, None beyond a long."""
    most = max(int(np.abs(x.min(initial=0))), int(np.abs(x.max(initial=0)))) * n + max(map(abs, sums))
    if most < 1 << 31 and most * most * x.shape[1] <= MOST_LONG:
        return ((x * n - np.array(sums)) ** 2).sum(1).tolist()
    gap = x.astype(object) * n - np.array(sums, dtype=object)
    return [int(v) if v <= MOST_LONG else None for v in (gap * gap).sum(1)]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining
    vector and component, components numbered from 1 by falling eigenvalue."""
    rows, width = whole(vectors, scale, key, vector)
    schema = SCHEMA.format(dict(vectors.dtypes)[key])
    # in as many tasks as its size asks for: each sends a matrix
    distinct, _ = sized(rows.select("x").distinct(), F.lit(8 * width))
    found = fit(distinct, width, components, **how) if width else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, found)
    mean, turn, k, explained = found.mean, found.vectors * found.scale, len(found.values), np.maximum(found.values, 0) / found.trace if found.trace else found.values * 0
    explained = np.where(np.isfinite(found.scale), explained, 0.0)

    def project(batches):
        for b in batches:
            for x in blocks([b]):
                w = ((x - mean) @ turn).ravel()
                m = len(x)
                deviation = pa.array(deviations(x, found.n, found.sums), pa.int64())
                by_row = pa.array(np.repeat(np.arange(m), k))
                columns = [b.column(0).take(by_row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)), deviation.take(by_row), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
