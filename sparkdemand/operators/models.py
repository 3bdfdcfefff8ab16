"""Regressors on the feature matrix: naive, ridge, forest, boosted trees, and the two-stage design.

Every fitted model is a plain ``pyspark.ml`` pipeline (fill nulls, assemble, regress, clip at zero), so it
can be saved, loaded and applied to any number of series at once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.functions.columns import quoted

NAIVE, RIDGE, FOREST, BOOSTED, LEAFWISE = "Naive Baseline", "Ridge Baseline", "Random Forest", "Boosted Trees", "Leaf-wise Boosting"
DEFAULT_MODELS = (NAIVE, RIDGE, FOREST, BOOSTED)
SEED = 42

#: Training rows are dealt into one partition for each ``PIECE_ROWS`` rows, and ``LEAST_PIECES`` at least.
PIECE_ROWS = 25_000
LEAST_PIECES = 8

# Tuned settings of the two-stage batch experiment.
TWO_STAGE_RIDGE = {"orders": 49.927017883207526, "sales": 49.96758009381003}


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def prediction_column(model: str) -> str:
    return "pred_" + "".join(ch if ch.isalnum() else "_" for ch in model.lower())


@dataclass
class ForecastModel:
    """A fitted pipeline with the names of its inputs; category columns are encoded inside the pipeline."""

    name: str
    feature_cols: tuple[str, ...]
    pipeline: PipelineModel
    target: str = "Sales"

    @property
    def core(self):
        """The regression stage, ``None`` for the naive model."""
        return self.pipeline.stages[-2] if len(self.pipeline.stages) > 2 else None

    @property
    def categories(self) -> tuple[str, ...]:
        """Columns that the pipeline encodes as sparse vectors."""
        return tuple(c for s in self.pipeline.stages if isinstance(s, StringIndexerModel) for c in s.getInputCols())

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Add the prediction: null inputs count as zero, results are never negative."""
        return self.pipeline.transform(df).select(*map(quoted, df.columns), F.col("_clipped").alias(output))

    def category_part(self, df: DataFrame, output: str) -> DataFrame:
        """Add what the categories contribute to a linear prediction: the prediction with all other inputs missing, less the intercept."""
        bare = df.withColumns({c: F.lit(None).cast("double") for c in self.feature_cols})
        kept = [F.col("_kept." + _tick(c)).alias(c) for c in df.columns]
        scored = self.pipeline.transform(bare.select("*").withColumn("_kept", F.struct(*map(quoted, df.columns))))
        return scored.select(*kept, (F.col("_prediction") - float(self.core.intercept)).alias(output))

    def weights(self) -> np.ndarray | None:
        core = self.core
        if core is None:
            return None
        return core.coefficients.toArray() if hasattr(core, "coefficients") else core.featureImportances.toArray()


def naive_model(lag: str, target: str = "Sales") -> ForecastModel:
    """Predict the first lag column."""
    stage = SQLTransformer(statement=f"SELECT *, greatest(0D, coalesce(cast({_tick(lag)} AS double), 0D)) AS _clipped FROM __THIS__")
    return ForecastModel(NAIVE, (lag,), PipelineModel(stages=[stage]), target)


def _fill_stage(features: Sequence[str]) -> SQLTransformer:
    filled = ", ".join(f"coalesce(cast({_tick(c)} AS double), 0D) AS _f{i}" for i, c in enumerate(features))
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def ridge_regressor(train: DataFrame, target: str, alpha: float) -> LinearRegression:
    """Least squares with penalty ``alpha * |w|^2``.

    Spark divides the loss by n and works on the standardised target, hence the rescaled penalty.
    """
    row = train.agg(F.count(quoted(target)).alias("n"), F.stddev_pop(quoted(target).cast("double")).alias("s")).first()
    reg = alpha * (row["s"] or 0.0) / max(row["n"], 1)
    return LinearRegression(
        featuresCol="_features",
        labelCol="_label",
        predictionCol="_prediction",
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=reg,
        tol=1e-14,
        maxIter=5000,
    )


def varying_columns(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with more than one value (null counts as zero).

    A constant one gets no weight in ridge anyway, but would make the normal equations singular and send the
    solver to an iterative, approximate method.
    """
    x = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in features]
    row = train.agg(*[(F.max(c) > F.min(c)).alias(f"v{i}") for i, c in enumerate(x)]).first()
    return [c for i, c in enumerate(features) if row[f"v{i}"]] or list(features[:1])


def build_regressor(name: str, train: DataFrame, target: str, params: Mapping | None = None):
    """Estimator by model name; ``params`` override the defaults."""
    p = dict(params or {})
    common = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction", "seed": SEED}
    if name == RIDGE:
        return ridge_regressor(train, target, p.get("alpha", 1.0))
    if name == BOOSTED or name == LEAFWISE:
        depth = 7 if name == LEAFWISE else 6
        base = {"maxIter": 150, "maxDepth": depth, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
        return GBTRegressor(**{**base, **common, **p})
    base = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"}
    return RandomForestRegressor(**{**base, **common, **p})


def fit_model(
    name: str,
    train: DataFrame,
    features: Sequence[str],
    target: str = "Sales",
    params: Mapping | None = None,
    clip: bool = True,
    categories: Sequence[str] = (),
) -> ForecastModel:
    """Fit one model on rows that carry the feature columns and the target.

    ``categories`` are text columns with any number of levels.  They become sparse 0/1 vectors inside the pipeline (one entry
    a row), so they cost neither columns nor a wide matrix; unseen and missing levels are all zeros.
    """
    if name == RIDGE:
        features = varying_columns(train, features)
    fill = _fill_stage(features)
    filled, encoders = fill.transform(train), []
    if categories:
        index, vector = [f"_i{i}" for i in range(len(categories))], [f"_v{i}" for i in range(len(categories))]
        # "keep" numbers what is unseen or missing last, and the last level is the one without an entry.
        for stage in (
            StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=vector, dropLast=True),
        ):
            encoders.append(stage.fit(filled))
            filled = encoders[-1].transform(filled)
    gather = VectorAssembler(inputCols=[*[f"_f{i}" for i in range(len(features))], *[f"_v{i}" for i in range(len(categories))]], outputCol="_features")
    ready = gather.transform(filled).select("_features", quoted(target).cast("double").alias("_label"))
    estimator = build_regressor(name, train, target, params)
    if name == RIDGE and categories:
        estimator.setSolver("auto")  # the normal equations end at 4096 inputs
    fitted = estimator.fit(ready)
    result = "greatest(0D, _prediction)" if clip else "_prediction"
    finish = SQLTransformer(statement=f"SELECT *, {result} AS _clipped FROM __THIS__")
    return ForecastModel(name, tuple(features), PipelineModel(stages=[fill, *encoders, gather, fitted, finish]), target)


@dataclass
class TrainingResult:
    """Fitted models, and the validation and test rows with one prediction column per model."""

    models: dict[str, ForecastModel]
    val: DataFrame
    test: DataFrame
    times: dict[str, float]
    feature_cols: tuple[str, ...]
    target: str
    prediction_cols: dict[str, str] = field(default_factory=dict)


def first_lag(columns: Sequence[str], target: str) -> str | None:
    return next((c for c in columns if c.startswith("lag_") and target in c), None)


def stable_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Same rows in the same partitions every time, so seeded row sampling in the trees repeats itself.

    The rebalance hint lets AQE size the partitions by bytes: one for a small table, many for a large one,
    with a hot key split up.  That keeps the per-partition statistics of the tree learners in proportion.
    """
    return df.hint("rebalance", *map(quoted, keys)).sortWithinPartitions(*map(quoted, keys))


def dealt_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`stable_order`, for rows that are cached, where AQE leaves the hint at the shuffle width of the session.

    The number of partitions follows from the rows alone: the tree learners run thousands of short stages, and each costs
    a task and a set of statistics per partition, so the shuffle width of the session would set their time.
    """
    pieces = max(LEAST_PIECES, math.ceil(df.count() / PIECE_ROWS))
    return df.repartition(pieces, *map(quoted, keys)).sortWithinPartitions(*map(quoted, keys))


def train_models(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str = "Sales",
    names: Sequence[str] = DEFAULT_MODELS,
    params: Mapping[str, Mapping] | None = None,
    order_keys: Sequence[str] = ("Date",),
) -> TrainingResult:
    """Fit the named models one after the other on one cached training set; predictions stay distributed."""
    lag = first_lag(train.columns, target)
    wanted = [*dict.fromkeys([*features, *([lag] if lag else []), target, *order_keys])]
    rows = dealt_rows(train.select(*map(quoted, wanted)), order_keys).persist(StorageLevel.MEMORY_AND_DISK)
    models, times, cols = {}, {}, {}
    try:
        rows.count()  # the feature matrix is made before the clock starts
        for name in names:
            t0 = time.time()
            if name == NAIVE:
                if lag is None:
                    continue
                models[name] = naive_model(lag, target)
            else:
                models[name] = fit_model(name, rows, features, target, (params or {}).get(name))
            times[name] = round(time.time() - t0, 3)
            cols[name] = prediction_column(name)
    finally:
        rows.unpersist()
    for name, model in models.items():
        val, test = (model.transform(part, cols[name]) for part in (val, test))
    return TrainingResult(models, val, test, times, tuple(features), target, cols)


# --- linear models as plain expressions ----------------------------------------------------------


def linear_prediction(model: ForecastModel, value_of, part: Column | None = None) -> Column:
    """Prediction of a linear model as one column expression over ``value_of(feature)`` columns and the part of its categories."""
    core = model.core
    out = F.lit(float(core.intercept)) if part is None else part + F.lit(float(core.intercept))
    for name, w in zip(model.feature_cols, core.coefficients.toArray()[: len(model.feature_cols)], strict=True):
        if w != 0.0:
            out = out + F.coalesce(value_of(name).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return F.greatest(F.lit(0.0), out)


# --- two stages -----------------------------------------------------------------------------------


@dataclass
class TwoStageModel:
    """Orders model first; its prediction is an input of the sales model."""

    orders: ForecastModel
    sales: ForecastModel
    column: str = "pred_orders"

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.sales.transform(self.orders.transform(df, self.column), output)


def fit_two_stage(
    train: DataFrame,
    order_features: Sequence[str],
    sales_features: Sequence[str],
    order: str = "Order",
    sales: str = "Sales",
    name: str = RIDGE,
    order_params: Mapping | None = None,
    sales_params: Mapping | None = None,
) -> TwoStageModel:
    """Fit orders, then sales with the in-sample orders prediction added (rows with nulls are left out)."""
    used = [*dict.fromkeys([*order_features, *[c for c in sales_features if c != "pred_orders"], order, sales])]
    rows = train.dropna(subset=used).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if name == RIDGE:
            order_params = order_params or {"alpha": TWO_STAGE_RIDGE["orders"]}
            sales_params = sales_params or {"alpha": TWO_STAGE_RIDGE["sales"]}
        first = fit_model(name, rows, order_features, order, order_params, clip=False)
        staged = first.transform(rows, "pred_orders")
        inputs = [*[c for c in sales_features if c != "pred_orders"], "pred_orders"]
        second = fit_model(name, staged, inputs, sales, sales_params, clip=False)
    finally:
        rows.unpersist()
    return TwoStageModel(first, second)


def two_stage_errors(model: TwoStageModel, df: DataFrame, order: str = "Order", sales: str = "Sales") -> DataFrame:
    """Mean absolute error of both stages on one row."""
    needed = [*dict.fromkeys([*model.orders.feature_cols, *[c for c in model.sales.feature_cols if c != model.column], order, sales])]
    scored = model.transform(df.dropna(subset=needed), "_p")
    return scored.agg(
        F.avg(F.abs(quoted(sales) - F.col("_p"))).alias("sales_mae"),
        F.avg(F.abs(quoted(order) - quoted(model.column))).alias("orders_mae"),
    )
