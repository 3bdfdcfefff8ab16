"""The whole path from a raw table to a forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from sparkdemand.functions.columns import trim_headers
from sparkdemand.operators import evaluate, features, forecast, outliers
from sparkdemand.operators.clean import CleanOptions, clean_dataset
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.operators.models import BOOSTED, DEFAULT_MODELS, FOREST, TrainingResult, train_models
from sparkdemand.operators.roles import Roles, column_audit, dataset_scope, detect_frequency, detect_roles, standardize
from sparkdemand.operators.split import Split, chronological_split
from sparkdemand.session import keep

MIN_ROWS = 10


@dataclass
class Result:
    """Everything a report needs.  Tables are lazy; cached ones are released with :meth:`close`."""

    roles: Roles
    audit: DataFrame
    frequency: str
    clean: DataFrame
    clean_audit: DataFrame
    outlier_summary: DataFrame
    top_outliers: DataFrame
    scope: DataFrame
    features: DataFrame
    config: FeatureConfig
    split: Split
    training: TrainingResult
    leaderboard: DataFrame
    champion: str
    forecast: DataFrame
    forecast_summary: DataFrame
    cached: tuple[DataFrame, ...]

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()


def run_pipeline(
    df: DataFrame,
    overrides: Mapping[str, str] | None = None,
    models: Sequence[str] = DEFAULT_MODELS,
    params: Mapping[str, Mapping] | None = None,
    period: str = "3 Months",
    scenario: Mapping | None = None,
) -> Result:
    """Roles, cleaning, outliers, dataset series, features, split, models, leaderboard and forecast.

    The cleaned table, which every later step reads, is written to the checkpoint folder; the series and the feature matrix have one row per date and are cached.  The forecast comes from boosted trees, else the forest, else the best model on the leaderboard.
    """
    raw = trim_headers(df)
    roles, _ = detect_roles(raw)
    roles = roles.override(raw.columns, **(overrides or {}))
    if not roles.date or not roles.sales:
        raise ValueError("no date or sales column found; name them with overrides")
    std, _ = standardize(raw, roles)
    order = "Order" if roles.order else None
    cleaned = clean_dataset(
        std,
        CleanOptions(order=order, store=roles.store, product=roles.product, date_format=roles.date_format),
    )
    clean, held = keep(cleaned.data, False)
    frequency, lags, rolling = detect_frequency(clean, "Date")
    scope = dataset_scope(clean, "Date", "Sales", order).persist(StorageLevel.MEMORY_AND_DISK)
    config = FeatureConfig(order=order if order in scope.columns else None, lags=tuple(lags), rolling=tuple(rolling))
    matrix, config = features.fit_transform(scope, config)
    rows = features.complete_rows(matrix, config).persist(StorageLevel.MEMORY_AND_DISK)
    if len(rows.select("Date").take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError("too little history remains once lag features are complete")
    split = chronological_split(rows, "Date")
    training = train_models(split.train, split.val, split.test, config.feature_columns, "Sales", models, params)
    board = evaluate.leaderboard(training.test, "Sales", training.prediction_cols, training.times)
    champion = next((m for m in (BOOSTED, FOREST) if m in training.models), None) or board.first()["Model"]
    steps = forecast.horizon_for(period, frequency)
    future = forecast.recursive_forecast(scope, config, training.models[champion], steps, frequency, scenario)
    return Result(
        roles=roles,
        audit=column_audit(raw, roles),
        frequency=frequency,
        clean=clean,
        clean_audit=cleaned.audit,
        outlier_summary=outliers.outlier_summary(clean),
        top_outliers=outliers.top_outliers(clean, store=roles.store, product=roles.product),
        scope=scope,
        features=matrix,
        config=config,
        split=split,
        training=training,
        leaderboard=board,
        champion=champion,
        forecast=future,
        forecast_summary=forecast.forecast_summary(future, scope),
        cached=(*held, scope, rows, *cleaned.cached),
    )
