"""Ridge regression from sums that add up over rows: many penalties and folds from one pass over the data.

For inputs x and a target y everything that a ridge fit needs is in sum(z z'), z = (1, x, y).  Such sums add up, so each
segment of the rows gets its own and a fold's training set is the sum of its segments.  A task sends one matrix per segment,
Spark adds the cells, and (k + 2)^2 numbers per segment come to the driver, whatever the number of rows.  There each
penalty is one small linear system.  Errors need the rows again: a second pass scores all settings of a fold at once.

Null inputs count as zero, as in the other models; rows without a target are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.functions.columns import quoted

#: Rows that a task multiplies together.
BLOCK = 4096


@dataclass(frozen=True)
class RidgeWeights:
    """Weights and intercept of one fit; inputs that never vary have weight zero."""

    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float

    def prediction(self) -> Column:
        """The unclipped prediction as a column expression."""
        out = F.lit(float(self.intercept))
        for name, w in zip(self.features, self.weights, strict=True):
            if w != 0.0:
                out = out + F.coalesce(quoted(name).cast("double"), F.lit(0.0)) * F.lit(float(w))
        return out


def _inputs(rows: DataFrame, features: Sequence[str], target: str, segment: Column) -> DataFrame:
    x = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in features]
    return rows.select(segment.cast("int").alias("g"), F.array(*x, quoted(target).cast("double")).alias("z")).where(
        F.col("g").isNotNull() & quoted(target).isNotNull()
    )


def _blocks(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for g, own in batch.groupby("g")["z"]:
        for start in range(0, len(own), BLOCK):
            yield int(g), np.stack(own.iloc[start : start + BLOCK].to_numpy())


def _centre(rows: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    """Means of the inputs and the target: sums of what is left after taking them off lose no digits."""
    x = [F.avg(F.coalesce(quoted(c).cast("double"), F.lit(0.0))).alias(f"m{i}") for i, c in enumerate(features)]
    row = rows.where(quoted(target).isNotNull()).agg(*x, F.avg(quoted(target).cast("double")).alias("y")).first()
    return np.array([v or 0.0 for v in row])


def segment_sums(rows: DataFrame, features: Sequence[str], target: str, segment: Column, segments: int, centre: np.ndarray) -> np.ndarray:
    """``segments`` matrices of sum(z z') with z = (1, x - centre, y - centre); ``segment`` numbers the rows from 0 (null: left out)."""
    k = len(features) + 2

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((segments, k, k))
        for batch in batches:
            for g, z in _blocks(batch):
                z = np.column_stack([np.ones(len(z)), z - centre])
                total[g] += z.T @ z
        used = np.flatnonzero(total[:, 0, 0])
        i = np.arange(k * k)
        for g in used:
            yield pd.DataFrame({"g": g, "i": i, "v": total[g].ravel()})

    parts = _inputs(rows, features, target, segment).mapInPandas(work, "g int, i int, v double")
    out = np.zeros((segments, k * k))
    for row in parts.groupBy("g", "i").agg(F.sum("v").alias("v")).collect():  # segments * k * k rows
        out[row.g, row.i] = row.v
    return out.reshape(segments, k, k)


def solve(sums: np.ndarray, alpha: float, features: Sequence[str], centre: np.ndarray) -> RidgeWeights:
    """Least squares with the penalty ``alpha * |w|^2``; the intercept is free."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    scale = np.maximum(np.diag(sums)[1:-1], 1.0)
    varies = np.diag(xx) > 1e-12 * scale
    w = np.zeros(len(features))
    if varies.any():
        a = xx[np.ix_(varies, varies)] + alpha * np.eye(varies.sum())
        w[varies] = np.linalg.solve(a, xy[varies]) if alpha > 0 else np.linalg.lstsq(a, xy[varies], rcond=None)[0]
    level = (mean[-1] + centre[-1]) - (mean[:-1] + centre[:-1]) @ w
    return RidgeWeights(tuple(features), w, float(level))


def fit_ridge(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> RidgeWeights:
    """One fit from one pass over the rows (and one for the means)."""
    centre = _centre(rows, features, target)
    sums = segment_sums(rows, features, target, F.lit(0), 1, centre)
    return solve(sums[0], alpha, features, centre)


def fold_errors(
    placed: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], bounds: Sequence[tuple[int, int]], pos: str = "_pos"
) -> np.ndarray:
    """Errors of each penalty in each fold: an array (alphas, folds, 5) of rows, sum|e|, sum|y|, sum e^2 and sum|e/y|.

    ``bounds`` are the test intervals of expanding folds over the positions ``pos``: each starts where the one before ends, and
    all rows before it are its training set.
    """
    starts = [lo for lo, _ in bounds]
    at = F.col(pos)
    # Segment 0 is before the first test interval, segment i + 1 is test interval i.
    segment = F.when(at < bounds[-1][1], sum(((at >= lo).cast("int") for lo in starts), F.lit(0)))
    centre = _centre(placed, features, target)
    sums = np.cumsum(segment_sums(placed, features, target, segment, len(bounds) + 1, centre), axis=0)
    fits = [[solve(sums[f], a, features, centre) for a in alphas] for f in range(len(bounds))]
    weights = np.array([[m.weights for m in row] for row in fits])
    levels = np.array([[m.intercept for m in row] for row in fits])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(bounds), len(alphas), 5))
        for batch in batches:
            for g, z in _blocks(batch[batch["g"] > 0]):
                y = z[:, -1:]
                e = np.abs(z[:, :-1] @ weights[g - 1].T + levels[g - 1] - y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = np.where(y != 0, e / np.abs(y), 0.0)
                size = np.broadcast_to(np.abs(y), e.shape)
                total[g - 1] += np.stack([np.ones_like(e), e, size, e * e, share], axis=2).sum(axis=0)
        f, a, i = np.indices(total.shape)
        yield pd.DataFrame({"f": f.ravel(), "a": a.ravel(), "i": i.ravel(), "v": total.ravel()})

    parts = _inputs(placed, features, target, segment).mapInPandas(work, "f int, a int, i int, v double")
    out = np.zeros((len(alphas), len(bounds), 5))
    for row in parts.groupBy("f", "a", "i").agg(F.sum("v").alias("v")).collect():  # folds * settings * 5 rows
        out[row.a, row.f, row.i] = row.v
    return out
