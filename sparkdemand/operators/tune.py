"""Seeded random search over model settings with expanding-window folds."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.functions.columns import EPS, quoted
from sparkdemand.operators.models import BOOSTED, FOREST, LEAFWISE, RIDGE, SEED, fit_model
from sparkdemand.operators.order import with_row_index
from sparkdemand.operators.ridge import fold_errors
from sparkdemand.operators.split import fold_bounds

MIN_ROWS = 30

# Search spaces as (kind, low, high[, step]).  "library" is the default search, "batch" the wider
# one of the batch experiment.
SPACES = {
    "library": {
        BOOSTED: {
            "maxIter": ("int", 50, 250, 25),
            "maxDepth": ("int", 3, 9, 1),
            "stepSize": ("log", 0.01, 0.2),
            "subsamplingRate": ("float", 0.6, 1.0),
            "featureSubsetStrategy": ("share", 0.6, 1.0),
        },
        FOREST: {
            "numTrees": ("int", 50, 200, 25),
            "maxDepth": ("int", 4, 14, 1),
            "minInstancesPerNode": ("half", 2, 8),
        },
        RIDGE: {"alpha": ("log", 1e-3, 100.0)},
    },
    "batch": {
        BOOSTED: {
            "maxIter": ("int", 200, 700, 1),
            "maxDepth": ("int", 3, 10, 1),
            "stepSize": ("float", 0.01, 0.2),
            "subsamplingRate": ("float", 0.7, 1.0),
            "featureSubsetStrategy": ("share", 0.7, 1.0),
        },
        LEAFWISE: {
            "maxIter": ("int", 200, 800, 1),
            "maxDepth": ("leaves", 20, 150),
            "stepSize": ("float", 0.01, 0.3),
            "subsamplingRate": ("float", 0.6, 1.0),
            "featureSubsetStrategy": ("share", 0.6, 1.0),
        },
        RIDGE: {"alpha": ("float", 0.1, 50.0)},
    },
}
MEASURES = ("WAPE", "MAE", "MSE", "RMSE", "MAPE")


def draw(space: Mapping, rng: random.Random) -> dict:
    """One random setting."""
    out = {}
    for name, (kind, lo, hi, *step) in space.items():
        if kind == "int":
            out[name] = lo + rng.randrange((hi - lo) // step[0] + 1) * step[0]
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        elif kind == "half":  # rows needed to split a node, as the smallest child size
            out[name] = max(1, rng.randint(lo, hi) // 2)
        elif kind == "leaves":  # number of leaves, as the depth of a full tree
            out[name] = max(1, math.ceil(math.log2(rng.randint(lo, hi))))
        elif kind == "share":
            out[name] = f"{rng.uniform(lo, hi):.4f}"
        else:
            out[name] = rng.uniform(lo, hi)
    return out


def fold_measures(scored: DataFrame, actual: str, predicted: str) -> dict[str, float]:
    """Fold errors from one aggregation.  WAPE falls back to MAE when the actuals sum to nothing."""
    y, p = quoted(actual).cast("double"), quoted(predicted).cast("double")
    e = F.abs(y - p)
    row = scored.agg(
        F.sum(e).alias("abs_err"), F.sum(F.abs(y)).alias("abs_y"), F.avg(e).alias("mae"), F.avg(e * e).alias("mse"),
        F.avg(F.try_divide(e, F.abs(y))).alias("mape"),
    ).first()
    mae = row["mae"] or 0.0
    wape = row["abs_err"] / row["abs_y"] if (row["abs_y"] or 0.0) > EPS else mae
    mse = row["mse"] or 0.0
    return {"WAPE": wape, "MAE": mae, "MSE": mse, "RMSE": math.sqrt(mse), "MAPE": row["mape"] or 0.0}


def ridge_measures(placed: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], bounds) -> list[dict[str, float]]:
    """Mean fold errors of every penalty from two passes over the rows, whatever the number of penalties.

    As in :func:`fold_measures`; rows with a zero target have no percentage error, here and there.
    """
    zero = placed.agg(*[F.count_if((quoted(target) == 0) & F.col("_pos").between(lo, hi - 1)).alias(f"z{i}") for i, (lo, hi) in enumerate(bounds)])
    zeros = list(zero.first())
    out = []
    for folds in fold_errors(placed, features, target, alphas, bounds):
        made = []
        for (n, e, y, ee, share), z in zip(folds.tolist(), zeros, strict=True):
            mae, mse = (e / n, ee / n) if n else (0.0, 0.0)
            mape = share / (n - z) if n > z else 0.0
            made.append({"WAPE": e / y if y > EPS else mae, "MAE": mae, "MSE": mse, "RMSE": math.sqrt(mse), "MAPE": mape})
        out.append({m: sum(f[m] for f in made) / len(made) for m in MEASURES})
    return out


@dataclass
class TuningResult:
    status: str
    message: str
    best_params: dict
    best_score: float | None
    trials: DataFrame | None


def tune_model(
    df: DataFrame,
    features: Sequence[str],
    target: str = "Sales",
    model: str = BOOSTED,
    n_trials: int = 15,
    n_splits: int = 3,
    objective: str = "WAPE",
    space: str | Mapping = "library",
    date: str = "Date",
    tie: Sequence[str] | None = None,
    drop_missing: bool = False,
    seed: int = SEED,
    parallel: int = 4,
) -> TuningResult:
    """Random search; the score of a setting is its mean fold error.

    Rows get their position once and are cached; folds are filters on that position.  Trials are drawn up
    front from one seed and run from a few driver threads, so the cluster works on several fits at a time
    while the outcome does not depend on the order they finish in.  Ridge needs no fit per trial: the sums of each fold are
    taken once and every penalty is solved from them.
    """
    keys = [*dict.fromkeys([*features, target, date, *(tie or [])])]
    rows = df.select(*map(quoted, keys))
    if drop_missing:
        rows = rows.dropna()
    placed = with_row_index(rows, date, tie, "_pos").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = placed.count()
        if n < MIN_ROWS:
            return TuningResult("error", "Dataset too small for expanding-window tuning.", {}, None, None)
        chosen = SPACES[space][model] if isinstance(space, str) else space
        rng = random.Random(seed)
        settings = [draw(chosen, rng) for _ in range(n_trials)]
        bounds = fold_bounds(n, n_splits)

        def run(number: int) -> tuple[int, dict]:
            folds = []
            for lo, hi in bounds:
                fitted = fit_model(model, placed.where(F.col("_pos") < lo), features, target, settings[number], clip=False)
                scored = fitted.transform(placed.where(F.col("_pos").between(lo, hi - 1)), "_p")
                folds.append(fold_measures(scored, target, "_p"))
            return number, {m: sum(f[m] for f in folds) / len(folds) for m in MEASURES}

        if model == RIDGE:
            done = list(enumerate(ridge_measures(placed, features, target, [s["alpha"] for s in settings], bounds)))
        else:
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                done = list(pool.map(inheritable_thread_target(df.sparkSession)(run), range(n_trials)))
    finally:
        placed.unpersist()
    best, scores = min(done, key=lambda t: (t[1][objective], t[0]))
    records = [(i, *[float(s[m]) for m in MEASURES], {k: str(v) for k, v in settings[i].items()}) for i, s in done]
    schema = "Trial int, " + ", ".join(f"{m} double" for m in MEASURES) + ", params map<string,string>"
    trials = df.sparkSession.createDataFrame(records, schema).orderBy(objective, "Trial")
    return TuningResult("success", "", settings[best], round(scores[objective], 4), trials)
