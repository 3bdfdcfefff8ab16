"""Order statistics that never gather a whole column or a hot key in one task.

Three jobs need a total order: exact quantiles, mid-ranks and row positions.  A plain
``Window.orderBy`` without a partition, or ``percentile`` on a column with billions of distinct
values, would put everything on one executor.  Here the work is always

1. reduce to distinct values with counts (map-side combine absorbs hot values),
2. cut the values into ranges of similar size with an approximate sketch (any cut is correct,
   a poor one is only slower),
3. cumulate the counts per range in a small table, and
4. sort inside the ranges, in parallel.

There is one form for every input size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdemand.session import cut_lineage

def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; keeps the key columns of the left side."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one-row right side
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """Equi-join of many rows with a table of one row per ``key``; hot keys are split by a hash of ``spread``.

    Each row of ``right`` is repeated ``salts`` times, so it must be much shorter than ``left``.
    """
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    work = left.withColumn("_salt", F.pmod(F.xxhash64(_exact(spread)), F.lit(salts)).cast("int"))
    return work.join(salted, [key, "_salt"]).drop("_salt")


# --- value ranges ---------------------------------------------------------------------------


def range_count(df: DataFrame) -> int:
    """Number of value ranges: follows the shuffle width of the session."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_value_range(df: DataFrame, value: str, n: int, name: str = "_range") -> DataFrame:
    """Number the value ranges of ``value`` (monotone in the value).

    The cut points are sketched from the rows given (distinct values with counts, so that one heavy value takes
    one cut) and travel as one broadcast row of ``n`` numbers.  Each row looks its range up in two steps (coarse,
    then fine), about ``2*sqrt(n)`` comparisons.
    """
    step = max(1, math.isqrt(n))
    sketch = F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n).alias("_cuts")
    cuts = df.agg(sketch).select(
        "_cuts", F.filter("_cuts", lambda _, i: (i + 1) % step == 0).alias("_coarse")
    )
    v = F.col(value)
    coarse = F.size(F.filter("_coarse", lambda c: c < v)) * step
    fine = F.size(F.filter(F.slice("_cuts", F.col("_block") + 1, step), lambda c: c < v))
    return (
        df.crossJoin(F.broadcast(cuts))
        .withColumn("_block", coarse)
        .withColumn(name, F.col("_block") + fine)
        .drop("_cuts", "_coarse", "_block")
    )


def _value_counts(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    return (
        df.where(_exact(value).isNotNull())
        .groupBy(*by, _exact(value).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )


# --- exact quantiles ------------------------------------------------------------------------


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group: columns ``*by, q_0, q_1, ...``.

    Only the value ranges that hold a wanted rank are sorted.
    """
    by = list(by)
    counts = with_value_range(_value_counts(df, value, by), "_v", ranges or range_count(df))
    wanted = wanted_ranges(counts, probs, by)
    return quantiles_in(join_keys(counts, wanted, [*by, "_range"]), probs, by)


def _rank_bounds(probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Position of every quantile in a group of ``_n`` rows, and the ranks around it."""
    pos = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    return [(p, F.floor(p), F.ceil(p)) for p in pos]


def wanted_ranges(counts: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The ranges of each group that hold a wanted rank: ``by, _range, _rc, _off, _n`` (its rows, those before it, all).

    Each row of ``counts`` stands for ``_c`` rows.
    """
    totals = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_rc"))
    in_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by,
        "_range",
        "_rc",
        F.coalesce(F.sum("_rc").over(before), F.lit(0)).alias("_off"),
        F.sum("_rc").over(in_group).alias("_n"),
    )
    wanted = F.lit(False)
    for _, lo, hi in _rank_bounds(probs):
        for r in (lo, hi):
            wanted = wanted | ((r >= F.col("_off")) & (r < F.col("_off") + F.col("_rc")))
    return totals.where(wanted)


def quantiles_in(picked: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Quantiles ``by, q_0, q_1, ...`` from the values ``_v`` with counts ``_c`` of the ranges of :func:`wanted_ranges`."""
    ranks = _rank_bounds(probs)
    upto = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = picked.withColumn("_end", F.col("_off") + F.sum("_c").over(upto))
    start = F.col("_end") - F.col("_c")
    aggs = [F.first("_n").alias("_n")]
    for i, (_, lo, hi) in enumerate(ranks):
        for tag, r in (("lo", lo), ("hi", hi)):
            aggs.append(F.max(F.when((r >= start) & (r < F.col("_end")), F.col("_v"))).alias(f"_{tag}_{i}"))
    out = picked.groupBy(*by).agg(*aggs)
    # Weights as in the built-in aggregate, so both forms agree to the last bit.
    quantile = []
    for i, (p, _, _) in enumerate(ranks):
        lo, hi = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        between = (F.ceil(p) - p) * lo + (p - F.floor(p)) * hi
        quantile.append(F.when(lo == hi, lo).otherwise(between).alias(f"q_{i}"))
    return out.select(*by, *quantile)


def agg_with_quantiles(
    df: DataFrame,
    by: Sequence[str],
    aggs: Sequence[Column],
    quantiles: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """``groupBy(by).agg(aggs)`` plus exact quantiles ``{alias: (column, probability)}``.

    The quantiles come from :func:`exact_quantiles`, so neither a hot group nor a long value list meets in one task.
    """
    by = list(by)
    columns: dict[str, list[tuple[str, float]]] = {}
    for alias, (col, p) in quantiles.items():
        columns.setdefault(col, []).append((alias, p))
    if aggs:
        out = df.groupBy(*by).agg(*aggs)
    elif by:
        out = df.select(*by).distinct()
    else:
        out = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    for col, wanted in columns.items():
        q = exact_quantiles(df, col, [p for _, p in wanted], by).withColumnsRenamed(
            {f"q_{j}": alias for j, (alias, _) in enumerate(wanted)}
        )
        out = join_keys(out, q, by, "left") if by else out.crossJoin(F.broadcast(q))
    return out.drop("_one")


# --- mid-ranks ------------------------------------------------------------------------------


def mid_ranks(df: DataFrame, value: str, ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """Average rank of every distinct value: ``_v, _c, rank`` with ``rank`` starting at 1.

    ``weight`` names a column with the number of rows that a row stands for.
    """
    counts = _value_counts(df, value, [], weight)
    counts = with_value_range(counts, "_v", ranges or range_count(df))
    totals = counts.groupBy("_range").agg(F.sum("_c").alias("_rc"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_rc").over(before), F.lit(0)).alias("_off"))
    upto = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.join(totals, "_range").withColumn("_end", F.col("_off") + F.sum("_c").over(upto))
    return ends.select("_v", "_c", (F.col("_end") - (F.col("_c") - 1) / 2.0).alias("rank"))


# --- chunks and positions -------------------------------------------------------------------


def with_chunks(df: DataFrame, keys: Sequence[str], tie: Sequence[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    """Split key groups into ordered pieces of bounded size.

    Returns the frame, the chunk columns (``keys`` + ``_piece``) and the order inside a chunk.  Rows are dealt into
    as many contiguous ranges of ``(keys, tie)`` as the session shuffles to, and the range is the piece: a hot key
    spans as many pieces as its share of the rows, and ``(keys, _piece, tie)`` sorts like ``(keys, tie)``, texts in
    text order.  Without a tie-break a hash of the row orders rows that share the keys; rows equal in all columns of
    the order are dealt by their place.  The ranges come from a sample, so the dealt rows are written down.
    """
    order = list(tie) if tie else ["_tie"]
    work = df if tie else df.withColumn("_tie", F.xxhash64(*map(_exact, df.columns)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = [*map(_exact, keys), *map(_exact, order), F.monotonically_increasing_id()]
    dealt = work.repartitionByRange(n, *bounds).withColumn("_piece", F.spark_partition_id())
    return cut_lineage(dealt), [*keys, "_piece"], order


def _exact(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_index(df: DataFrame, order_col: str, tie: Sequence[str] | None = None, name: str = "row_index") -> DataFrame:
    """Position 0..n-1 in the order of ``order_col`` and the tie-break, without a global sort.

    Rows are dealt into ranges and counted per range; that table, one row per range, is cumulated and gives each range
    its first position.
    """
    work, _, order = with_chunks(df, [order_col], tie)
    sizes = work.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_piece").orderBy(_exact(order_col), *map(_exact, order))
    return (
        work.join(F.broadcast(offsets), "_piece")
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .select(*map(_exact, df.columns), name)
    )


def repeat_rows(df: DataFrame, times: str, block: int = 1_000_000) -> DataFrame:
    """Emit each row ``times`` times.  Large counts are split into blocks that spread over the cluster."""
    n = F.col(times)
    blocks = df.where(n > 0).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(block).cast("long"))))
    blocks = blocks.repartition(*[c for c in df.columns], "_at")
    last = F.least(F.col("_at") + block, n) - 1
    return blocks.withColumn("_at", F.explode(F.sequence(F.col("_at"), last))).drop("_at", times)
