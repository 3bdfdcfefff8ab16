"""Accuracy measures, leaderboard, diagnostics and feature importances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.functions.columns import EPS, quoted, round_to
from sparkdemand.operators.outliers import histogram

MODEL_LABEL = "Model"


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MSE, WAPE, accuracy, safe MAPE and R2 in one aggregation; zeros when no pair is left."""
    y, p = F.col("_y"), F.col("_p")
    pairs = df.select(*by, quoted(actual).cast("double").alias("_y"), quoted(predicted).cast("double").alias("_p"))
    usable = pairs.where(y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p))
    err = F.abs(y - p)
    m = usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.sum(err).alias("abs_err"),
        F.sum(F.abs(y)).alias("abs_y"),
        F.avg(err / F.greatest(F.abs(y), F.lit(1.0))).alias("mape"),
        F.var_pop(y).alias("var_y"),
    )
    wape = F.when(F.col("abs_y") > EPS, F.col("abs_err") / F.col("abs_y")).otherwise(0.0)
    r2 = F.when((F.col("n") > 1) & (F.col("var_y") > 1e-7), 1 - F.col("mse") / F.col("var_y")).otherwise(0.0)
    zero = F.lit(0.0)
    return m.select(
        *by,
        round_to(F.coalesce("mae", zero), 2).alias("MAE"),
        round_to(F.coalesce(F.sqrt("mse"), zero), 2).alias("RMSE"),
        round_to(F.coalesce("mse", zero), 2).alias("MSE"),
        round_to(wape * 100, 2).alias("WAPE_Pct"),
        F.when(F.col("n") == 0, zero).otherwise(round_to(F.greatest(zero, (1 - wape) * 100), 2)).alias("WAPE_Accuracy_Pct"),
        round_to(F.coalesce(F.col("mape") * 100, zero), 2).alias("Safe_MAPE_Pct"),
        round_to(r2, 4).alias("R2"),
    )


def wape_mape(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The batch experiment's measures: absolute error over (sum of actuals + 1e-8), and plain MAPE."""
    y, p = quoted(actual).cast("double"), quoted(predicted).cast("double")
    return df.agg(
        (F.sum(F.abs(y - p)) / (F.sum(y) + 1e-8)).alias("WAPE"), F.avg(F.abs(F.try_divide(y - p, y))).alias("MAPE")
    )


def leaderboard(predictions: DataFrame, actual: str, models: Mapping[str, str], times: Mapping[str, float] | None = None) -> DataFrame:
    """One row per model (``models`` maps names to prediction columns), best accuracy first.

    All models are scored in one pass over the wide prediction table.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias(MODEL_LABEL), quoted(c).cast("double").alias("_pred")) for n, c in models.items()])
    long = predictions.select(quoted(actual).alias("_actual"), F.explode(pairs).alias("m")).select("_actual", "m.*")
    scored = regression_metrics(long, "_actual", "_pred", [MODEL_LABEL])
    out = scored.select(MODEL_LABEL, F.col("WAPE_Accuracy_Pct").alias("Accuracy_Pct"), "MAE", "RMSE", "WAPE_Pct", "R2")
    if times is not None:
        known = F.create_map(*[F.lit(x) for n in models for x in (n, float(times.get(n, 0.0)))])
        out = out.withColumn("Train_Time_s", known[F.col(MODEL_LABEL)])
    return out.orderBy(F.desc("Accuracy_Pct"), "MAE", MODEL_LABEL)


def diagnostics(df: DataFrame, date: str, actual: str, predicted: str) -> DataFrame:
    """Actual, predicted, residual, absolute and relative error per row."""
    y, p = quoted(actual).cast("double"), quoted(predicted).cast("double")
    r = y - p
    return df.select(
        F.col(date).cast("date").alias("Date"),
        round_to(y, 2).alias("Actual_Sales"),
        round_to(p, 2).alias("Predicted_Sales"),
        round_to(r, 2).alias("Residual"),
        round_to(F.abs(r), 2).alias("Absolute_Error"),
        round_to(F.abs(r) / F.greatest(y, F.lit(1.0)) * 100, 2).alias("Percentage_Error"),
    )


def parity_range(diag: DataFrame) -> DataFrame:
    """Common axis range of actual and predicted values."""
    return diag.agg(
        F.least(F.min("Actual_Sales"), F.min("Predicted_Sales")).alias("min_value"),
        F.greatest(F.max("Actual_Sales"), F.max("Predicted_Sales")).alias("max_value"),
    )


def residual_histogram(diag: DataFrame, bins: int = 25) -> DataFrame:
    return histogram(diag, "Residual", bins)


def importance_table(spark, names: Sequence[str], weights: Sequence[float], top_n: int = 20) -> DataFrame:
    """Largest weights in percent of their sum."""
    size = [abs(float(w)) for w in weights]
    total = sum(size)
    rows = [(n, w / total * 100 if total > 1e-7 else w) for n, w in zip(names, size, strict=True)]
    table = spark.createDataFrame(rows, "Feature string, Importance_Pct double")
    return table.select("Feature", round_to("Importance_Pct", 2).alias("Importance_Pct")).orderBy(
        F.desc("Importance_Pct"), "Feature"
    ).limit(top_n)


def metric_cards(metrics: DataFrame, symbol: str = "$") -> DataFrame:
    """Four plain-language lines from the one-row metrics table."""
    c = F.col
    r2_pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("R2") * 100))

    def card(pos: int, name: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("metric"), value.alias("value"), text.alias("interpretation"))

    money = lambda x: F.concat(F.lit(symbol), F.format_number(x, 2))
    cards = [
        card(1, "WAPE-based Forecast Accuracy", F.format_string("%.2f%%", c("WAPE_Accuracy_Pct")),
             F.format_string("(1 - WAPE) x 100 on unseen chronological test data; WAPE is %.2f%%.", c("WAPE_Pct"))),
        card(2, "MAE (Mean Absolute Error)", money(c("MAE")),
             F.lit("Average absolute error in sales units per test row.")),
        card(3, "RMSE (Root Mean Squared Error)", money(c("RMSE")),
             F.lit("Weighs large misses more than small ones.")),
        card(4, "R2 Score (Model Performance)", F.format_string("%.4f", c("R2")),
             F.format_string("The model explains about %.1f%% of the variation in test sales.", r2_pct)),
    ]
    return metrics.select(F.inline(F.array(*cards)))
