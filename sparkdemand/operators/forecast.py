"""Recursive multi-step forecasts for many series at once.

Each series is reduced to its last few rows.  Naive and linear models run as one column expression: the
whole horizon is folded over an array of recent values, nothing is shuffled and no loop runs on the
driver.  Other models take one step for all series at a time: inputs from the arrays as column expressions, the fitted
pipeline, the prediction appended to the arrays; the state (one row per series) is written down after each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdemand.functions.columns import EPS, quoted, round_to
from sparkdemand.operators.features import (
    FeatureConfig,
    calendar_columns,
    flag_columns,
    growth_of,
    one_hot_columns,
    order_value_of,
)
from sparkdemand.operators.models import NAIVE, ForecastModel, linear_prediction
from sparkdemand.operators.ranges import is_long, with_positions
from sparkdemand.session import cut_lineage

# Steps per period and frequency (daily, weekly, monthly, anything else).
HORIZONS = {"1": (30, 4, 1, 4), "3": (90, 13, 3, 13), "6": (180, 26, 6, 26)}
HORIZON_DEFAULT = (30, 4, 6, 6)


def horizon_for(period: str, frequency: str = "Daily") -> int:
    """Steps for "1 Month", "3 Months" or "6 Months" at a frequency."""
    steps = next((v for k, v in HORIZONS.items() if k in period), HORIZON_DEFAULT)
    slot = next((i for i, f in enumerate(("daily", "weekly", "monthly")) if f in frequency.lower()), 3)
    return steps[slot]


def future_dates(last: Column, horizon: int, frequency: str = "Daily") -> Column:
    """Array of the next dates: days; Sundays on or after a week later; month starts on or after a month later."""
    f = frequency.strip().lower()
    if "weekly" in f:
        first = F.next_day(F.date_add(last, 6), "SUN")
        return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.date_add(first, i * 7))
    if "monthly" in f:
        x = F.add_months(last, 1)
        first = F.when(F.dayofmonth(x) == 1, x).otherwise(F.trunc(F.add_months(x, 1), "MM"))
        return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.add_months(first, i))
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.date_add(last, i))


def future_calendar(df: DataFrame, date: str, horizon: int, frequency: str = "Daily", entity: Sequence[str] = ()) -> DataFrame:
    """Future dates per series as rows: ``*entity, step, Date``."""
    last = df.groupBy(*entity).agg(F.max(F.col(date).cast("date")).alias("_last"))
    dates = F.posexplode(future_dates(F.col("_last"), horizon, frequency)).alias("_i", "Date")
    return last.select(*entity, dates).select(*entity, (F.col("_i") + 1).alias("step"), "Date")


def append_rows(history: DataFrame, future: DataFrame) -> DataFrame:
    """History followed by future rows; columns a side lacks are null."""
    return history.unionByName(future, allowMissingColumns=True)


# --- series state ---------------------------------------------------------------------------------


def series_state(series: DataFrame, config: FeatureConfig, scenario: Mapping | None = None) -> DataFrame:
    """One row per series: recent targets as arrays, the last date, and the last value of every other column.

    Only the rows a feature can still reach are kept, picked by a ranked window inside each series.
    ``scenario`` replaces carried values (price cut, promotion on, ...); one on the orders is their future value, in the
    column ``_fixed_order``.  A scenario on anything else is an error.
    """
    cols = series.columns
    known = {c for c in cols if c not in (*config.entity(cols), config.date, config.sales)}
    if unknown := sorted(set(scenario or {}) - known):
        raise ValueError(f"a scenario can set {sorted(known)}, not {unknown}")
    entity = config.entity(cols)
    newest = Window.partitionBy(*(map(quoted, entity) if entity else [F.lit(0)])).orderBy(F.desc(config.date))
    recent = series.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= config.depth)
    has_order = bool(config.order) and config.order in cols
    item = F.struct(
        (-F.col("_age")).alias("at"),
        quoted(config.sales).cast("double").alias("s"),
        (quoted(config.order).cast("double") if has_order else F.lit(None).cast("double")).alias("o"),
    )
    held = F.sort_array(F.collect_list(item))
    other = [c for c in cols if c not in (*entity, config.date, config.sales, config.order)]
    keep = [F.min_by(quoted(c), "_age").alias(c) for c in other]
    state = recent.groupBy(*map(quoted, entity)).agg(held.alias("_h"), F.max(config.date).alias("_last"), *keep)
    fixed = (scenario or {}).get(config.order) if has_order else None
    state = state.withColumn("_fixed_order", F.lit(fixed).cast("double"))
    for c, v in (scenario or {}).items():
        if c in other:
            state = state.withColumn(c, F.lit(v).cast(series.schema[c].dataType))
    return (
        state.withColumn("_s", F.transform("_h", lambda r: r["s"]))
        .withColumn("_o", F.transform("_h", lambda r: r["o"]))
        .withColumn("_last", F.col("_last").cast("date"))
        .drop("_h")
    )


def carried_features(config: FeatureConfig, columns: Sequence[str]) -> dict[str, Column]:
    """Inputs that stay the same over the horizon: flags, one-hot columns and carried numbers."""
    made = {**flag_columns(config, columns), **one_hot_columns(config.levels, columns)}
    return {c: made.get(c, quoted(c) if c in columns else None) for c in config.feature_columns if c in made or c in columns}


# --- the expression form ---------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once instead of once per use."""
    return F.transform(F.array(value), body)[0]


def _tail(values: Column, k: int) -> Column:
    n = F.size(values)
    return F.filter(F.slice(values, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), lambda x: x.isNotNull())


def _nth_back(values: Column, k: int) -> Column:
    return F.when(F.size(values) >= k, F.element_at(values, -k))


def _window_stat(xs: Column, stat: str) -> Column:
    if stat in ("min", "max"):
        return F.array_min(xs) if stat == "min" else F.array_max(xs)

    def mean(v: Column) -> Column:
        return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))

    def deviation(v: Column) -> Column:
        squares = _let(mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        return F.when(F.size(v) > 1, F.sqrt(squares / (F.size(v) - 1))).otherwise(0.0)

    return _let(xs, mean if stat == "mean" else deviation)


def _history_feature(name: str, config: FeatureConfig, sales: Column, order: Column) -> Column | None:
    """A lag, rolling, growth or order-value input computed from the value arrays."""
    of = {config.sales: sales, config.order: order}
    for target, values in of.items():
        for k in config.lags:
            if name == f"lag_{k}_{target}":
                return _nth_back(values, k)
        for k in config.rolling:
            if not name.startswith(f"rolling_{target}_{k}_"):
                continue
            return _window_stat(_tail(values, k), name.rsplit("_", 1)[1])
    if name == "sales_growth_lag":
        return growth_of(_nth_back(sales, config.lags[0]), _nth_back(sales, config.lags[1]))
    if name == "lag_1_aov":
        return order_value_of(_nth_back(sales, config.lags[0]), _nth_back(order, config.lags[0]))
    return None


def _grown(values: Column, x: Column, depth: int) -> Column:
    """The array with one more value, ``depth`` at most."""
    return F.slice(F.array_append(values, x), F.greatest(F.size(values) + 2 - depth, F.lit(1)), F.lit(depth))


def _inputs_at(date: Column, sales: Column, order: Column, config: FeatureConfig, carried: Mapping[str, Column]):
    """Function from the name of an input to its column at one step."""
    calendar = calendar_columns(date)

    def value_of(name: str) -> Column:
        if name in carried:
            return carried[name]
        if name in calendar:
            return calendar[name]
        found = _history_feature(name, config, sales, order)
        return F.lit(None).cast("double") if found is None else found

    return value_of


def _next_order(value_of, orders: ForecastModel | None, part: Column) -> Column:
    """Orders of a step: what the scenario sets, else the orders model's prediction, else unknown."""
    fixed = F.col("_fixed_order")
    return fixed if orders is None else F.coalesce(fixed, linear_prediction(orders, value_of, part))


def _is_folded(model: ForecastModel | None) -> bool:
    """Whether a model's whole horizon is one expression."""
    return model is None or model.name == NAIVE or hasattr(model.core, "coefficients")


def _fold_horizon(state: DataFrame, config: FeatureConfig, model: ForecastModel, orders: ForecastModel | None, order_input: str | None) -> Column:
    """Array of predictions: one fold over the future dates, feeding each prediction back as history."""
    carried = {c: F.col(f"_c{i}") for i, c in enumerate(carried_features(config, state.columns))}
    depth = config.depth

    def step(acc: Column, date: Column) -> Column:
        value_of = _inputs_at(date, acc["s"], acc["o"], config, carried)

        def predicted(o: Column) -> Column:
            def with_orders(name: str) -> Column:
                return o if name == order_input else value_of(name)

            if model.name == NAIVE:
                p = F.greatest(F.lit(0.0), F.coalesce(with_orders(model.feature_cols[0]), F.lit(0.0)))
            else:
                p = linear_prediction(model, with_orders, F.col("_part"))
            return F.struct(p.alias("p"), o.alias("o"))

        def moved(made: Column) -> Column:
            return F.struct(
                _grown(acc["s"], made["p"], depth).alias("s"),
                _grown(acc["o"], made["o"], depth).alias("o"),
                F.array_append(acc["p"], made["p"]).alias("p"),
                F.array_append(acc["q"], made["o"]).alias("q"),
            )

        return _let(_let(_next_order(value_of, orders, F.col("_order_part")), predicted), moved)

    none = F.array().cast("array<double>")
    start = F.struct(F.col("_s").alias("s"), F.col("_o").alias("o"), none.alias("p"), none.alias("q"))
    return F.aggregate(F.col("_dates"), start, step, lambda acc: F.struct(acc["p"].alias("p"), acc["q"].alias("q")))


def _step_horizon(
    state: DataFrame, config: FeatureConfig, model: ForecastModel, orders: ForecastModel | None, order_input: str | None, horizon: int
) -> DataFrame:
    """``_made`` as in :func:`_fold_horizon`, one step of the fitted pipelines for all series at a time.

    The state is written down after each step: longer plans would repeat the expressions of earlier steps.
    """
    carried = {c: F.col(f"_c{i}") for i, c in enumerate(carried_features(config, state.columns))}
    depth = config.depth
    none = F.array().cast("array<double>")
    raw = {c for m in (model, orders) if m for c in m.categories}
    held = ["_id", "_i", "_s", "_o", "_dates", "_fixed_order", "_p", "_q", *[f"_c{i}" for i in range(len(carried))], *sorted(raw)]
    keys = [*map(quoted, config.entity(state.columns))]
    rows = state.withColumns({"_id": F.struct(*keys) if keys else F.lit(0), "_i": F.lit(0), "_p": none, "_q": none}).select(*map(quoted, held))
    # The step is a column, so every step has the same expressions: they are built once, and their code is compiled once.
    value_of = _inputs_at(F.get("_dates", F.col("_i")), F.col("_s"), F.col("_o"), config, carried)

    def inputs_of(m: ForecastModel, extra: dict[str, Column], columns: list[str]) -> list[Column]:
        wanted = [extra.get(c, value_of(c)).alias(c) for c in m.feature_cols]
        return [*[F.col(c) for c in m.categories], *wanted, F.struct(*map(quoted, columns)).alias("_row")]

    order_inputs = inputs_of(orders, {}, held) if orders is not None else []
    sales_inputs = inputs_of(model, {order_input: F.col("_order")} if order_input else {}, [*held, "_order"])
    moved = {
        "_s": _grown(F.col("_s"), F.col("_sales"), depth),
        "_o": _grown(F.col("_o"), F.col("_order"), depth),
        "_i": F.col("_i") + 1,
        "_p": F.array_append("_p", F.col("_sales")),
        "_q": F.array_append("_q", F.col("_order")),
    }
    after = [moved[c].alias(c) if c in moved else quoted(c) for c in held]
    known = F.coalesce("_fixed_order", "_predicted").alias("_order") if orders is not None else F.col("_fixed_order").alias("_order")
    for _ in range(horizon):
        if orders is not None:
            rows = orders.transform(rows.select(*order_inputs), "_predicted").select("_row.*", "_predicted")
        rows = model.transform(rows.select(*map(quoted, held), known).select(*sales_inputs), "_sales").select("_row.*", "_sales")
        rows = cut_lineage(rows.select(*after))
    made = F.struct(F.col("_p").alias("p"), F.col("_q").alias("q")).alias("_made")
    return rows.select(*([f"_id.{k}" for k in keys_of(config, state)] if keys else []), "_dates", made)


def keys_of(config: FeatureConfig, df: DataFrame) -> list[str]:
    return ["`" + k.replace("`", "``") + "`" for k in config.entity(df.columns)]


# --- forecast ---------------------------------------------------------------------------------------


def recursive_forecast(
    series: DataFrame,
    config: FeatureConfig,
    model: ForecastModel,
    horizon: int = 7,
    frequency: str = "Daily",
    scenario: Mapping | None = None,
    orders: ForecastModel | None = None,
    order_input: str | None = None,
    with_orders: bool = False,
    digits: int | None = 2,
) -> DataFrame:
    """``*entity, step, Date, Forecasted_Sales`` for every series, each step built on the steps before it.

    ``series`` has one row per (entity, date), in the scope the model was fitted in.  Other columns keep
    their last value unless ``scenario`` sets them.  Future orders are what the scenario sets; else the prediction of the
    model ``orders`` (never negative), which then feeds the order features of later steps and, under the name
    ``order_input``, the sales model of the same step; else they are unknown and count as missing.  ``with_orders``
    adds ``Orders`` and ``Orders_Carried`` (whether they are known).  Values are rounded to ``digits``; with None they
    are left as they are, for callers that round to fewer digits (rounding twice moves 0.149 to 0.2).
    """
    state = series_state(series, config, scenario)
    entity = config.entity(series.columns)
    carried = carried_features(config, [c for c in state.columns if not c.startswith("_")])
    state = state.withColumn("_dates", future_dates(F.col("_last"), horizon, frequency)).withColumns(
        {f"_c{i}": c.cast("double") for i, c in enumerate(carried.values())}
    )
    if entity:
        # Few bytes but much arithmetic per series: keep the full shuffle width instead of letting it shrink.
        state = state.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *map(quoted, entity))
    if _is_folded(model) and _is_folded(orders):
        for m, name in ((model, "_part"), (orders, "_order_part")):
            state = m.category_part(state, name) if m is not None and m.categories else state.withColumn(name, F.lit(0.0))
        done = state.withColumn("_made", _fold_horizon(state, config, model, orders, order_input))
    else:
        done = _step_horizon(state, config, model, orders, order_input, horizon)
    zipped = F.arrays_zip(F.col("_dates").alias("d"), F.col("_made.p").alias("p"), F.col("_made.q").alias("q"))
    rows = done.select(*map(quoted, entity), F.posexplode(zipped).alias("_i", "_r"))
    shown = lambda c: F.col(c) if digits is None else round_to(F.col(c), digits)
    known = [shown("_r.q").alias("Orders"), F.col("_r.q").isNotNull().alias("Orders_Carried")] if with_orders else []
    return rows.select(
        *map(quoted, entity),
        (F.col("_i") + 1).alias("step"),
        F.col("_r.d").alias("Date"),
        shown("_r.p").alias("Forecasted_Sales"),
        *known,
    )


def forecast_checks(forecast: DataFrame, horizon: int, entity: Sequence[str] = ()) -> DataFrame:
    """Per series: rows, missing or infinite values, negative values, and whether all is well."""
    x = F.col("Forecasted_Sales")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        forecast.groupBy(*entity)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("invalid"), F.count_if(x < 0).alias("negative"))
        .withColumn("ok", (F.col("rows") == horizon) & (F.col("invalid") == 0) & (F.col("negative") == 0))
    )


def forecast_summary(forecast: DataFrame, history: DataFrame | None = None, sales: str = "Sales", date: str = "Date") -> DataFrame:
    """Total, mean, peak, low, change against the last actual periods, and trend of a one-series forecast."""
    x, back = F.col("Forecasted_Sales"), (-F.unix_date("Date")).alias("back")
    base = forecast.agg(
        F.sum(x).alias("total"),
        F.avg(x).alias("mean"),
        F.max(F.struct(x.alias("v"), back, F.col("Date").alias("d"))).alias("top"),
        F.min(F.struct(x.alias("v"), F.col("Date").alias("d"))).alias("low"),
        F.count(F.lit(1)).alias("h"),
        F.regr_slope(x, F.col("step").cast("double")).alias("slope"),
    )
    if history is not None and {sales, date} <= set(history.columns):
        recent = recent_total(history, base.select("h"), sales, date)
    else:
        recent = base.select(F.lit(0.0).alias("recent"))
    row = base.crossJoin(F.broadcast(recent))
    change = F.when(F.col("recent") > EPS, (F.col("total") - F.col("recent")) / F.col("recent") * 100).otherwise(0.0)
    rel = F.coalesce(F.col("slope") / F.greatest(F.col("mean"), F.lit(EPS)) * 100, F.lit(0.0))
    known = F.col("recent") > EPS
    up = (known & (F.col("change") >= 2.0)) | (~known & (rel > 1.0))
    down = (known & (F.col("change") <= -2.0)) | (~known & (rel < -1.0))
    return row.withColumn("change", change).select(
        round_to("total", 2).alias("total_forecast"),
        round_to("mean", 2).alias("avg_forecast"),
        F.col("top.d").alias("peak_period"),
        round_to(F.col("top.v"), 2).alias("peak_val"),
        F.col("low.d").alias("low_period"),
        round_to(F.col("low.v"), 2).alias("low_val"),
        F.when(up, "Increasing").when(down, "Decreasing").otherwise("Stable").alias("trend"),
        round_to("change", 2).alias("change_vs_recent_pct"),
        round_to("recent", 2).alias("recent_actual_total"),
    )


def recent_total(history: DataFrame, steps: DataFrame, sales: str = "Sales", date: str = "Date") -> DataFrame:
    """Sum of the last ``h`` dates of the history (``steps`` is a one-row table with ``h``); 0 if it is shorter."""
    days = history.groupBy(F.col(date).alias("_d")).agg(F.sum(sales).alias("_s"))
    if is_long(days, "_d"):
        placed = with_positions(days, [], ["_d"], "_pos", "_all").withColumn("_age", F.col("_all") - F.col("_pos"))
    else:
        placed = days.withColumn("_age", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_d"))))
    h = F.col("h")
    return (
        placed.crossJoin(F.broadcast(steps))
        .agg(F.sum(F.when(F.col("_age") <= h, F.col("_s"))).alias("s"), F.count(F.lit(1)).alias("n"), F.max("h").alias("h"))
        .select(F.when(F.col("n") >= h, F.col("s")).otherwise(0.0).alias("recent"))
    )


def stitched_curve(series: DataFrame, forecast: DataFrame, total: str = "Sales", date: str = "Date") -> DataFrame:
    """History and forecast as one curve; the last actual point is also the first forecast point."""
    actual = series.select(F.col(date).cast("date").alias("Date"), F.col(total).alias("value"), F.lit("actual").alias("kind"))
    last = actual.orderBy(F.desc("Date")).limit(1).withColumn("kind", F.lit("forecast"))
    ahead = forecast.select("Date", F.col("Forecasted_Sales").alias("value"), F.lit("forecast").alias("kind"))
    return actual.unionByName(last).unionByName(ahead)


def first_step_jump(series: DataFrame, forecast: DataFrame, total: str = "Sales", date: str = "Date") -> DataFrame:
    """Change in percent from the last actual value to the first forecast value."""
    last = series.agg(F.max_by(total, date).alias("last_actual"))
    first = forecast.agg(F.min_by("Forecasted_Sales", "step").alias("first_forecast"))
    gap = F.col("first_forecast") - F.col("last_actual")
    return last.crossJoin(F.broadcast(first)).withColumn("step_pct", gap / F.greatest("last_actual", F.lit(1.0)) * 100)
