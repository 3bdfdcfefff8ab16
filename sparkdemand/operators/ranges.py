"""Windows over series that are too long for one task.

Rows are dealt into contiguous ranges of (keys, order), one per partition, whatever the share of a key.  The rows of one
key in one range are a segment.  Three things then replace a window over the whole key:

* positions: the rows of earlier segments of the key, from a table with one row per segment, plus the place inside;
* sliding windows: each segment also gets the last ``depth`` rows before it (its halo), and the window runs inside;
* totals: plain aggregates.

Ranks of a number need no dealing by a sample: a sketch of the values cuts them into ranges (:func:`cut_sketch`), and a value that
is heavier than a range is a range of its own, whose rows are neither moved nor sorted.

Only keys that span several ranges need halos.  A range has at most two segments of such keys (its first and its last
key), so these segments are at most twice as many as ranges, and the halos hold ``depth`` rows for each.

A series by date has one row a day and is short in any case; :func:`is_long` tells by the type of the order column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdemand.functions.columns import quoted
from sparkdemand.operators.order import join_keys, quantiles_in, range_count, wanted_ranges, with_chunks
from sparkdemand.session import cut_lineage


def is_long(df: DataFrame, order: str) -> bool:
    """Whether a series ordered by this column may be long: everything but dates, which bound it by the calendar."""
    return not isinstance(df.schema[order].dataType, T.DateType)


@dataclass(frozen=True)
class Ranges:
    """Dealt rows (``_piece`` is the range) and the segments: ``keys, _piece, _rows, _start, _all``.

    ``_start`` counts the rows of the key before the segment, ``_all`` all rows of the key.
    """

    rows: DataFrame
    segments: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def inside(self) -> WindowSpec:
        """The window of a segment, in order."""
        return Window.partitionBy(*map(quoted, self.keys), "_piece").orderBy(*map(quoted, self.order))


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ranges:
    """Deal rows into ranges of (keys, order); rows equal in both are dealt by their place."""
    rows, _, _ = with_chunks(df, keys, order)
    sizes = rows.groupBy(*map(quoted, keys), "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per segment: for one key as many as ranges at most.
    of_key = Window.partitionBy(*(map(quoted, keys) if keys else [F.lit(0)]))
    before = of_key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    segments = sizes.withColumns({"_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_all": F.sum("_rows").over(of_key)})
    return Ranges(rows, segments, tuple(keys), tuple(order))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, count: str | None = None) -> DataFrame:
    """Place 0..n-1 of each row in its key, and on demand the rows of the key."""
    r = deal(df, keys, order)
    placed = join_keys(r.rows, r.segments, [*r.keys, "_piece"]).withColumn(name, F.col("_start") + F.row_number().over(r.inside) - 1)
    extra = [F.col("_all").alias(count)] if count else []
    return placed.select(*map(quoted, df.columns), name, *extra)


def _halos(r: Ranges, depth: int) -> DataFrame:
    """The rows that segments need from before their start, under the ``_piece`` that needs them."""
    spanning = r.segments.where("_rows < _all")
    later = F.sort_array(F.collect_list(F.struct("_piece", "_start")))
    targets = spanning.groupBy(*map(quoted, r.keys)).agg(later.alias("_targets"))
    # At most two rows per range.
    spanning = F.broadcast(join_keys(spanning, targets, r.keys) if r.keys else spanning.crossJoin(F.broadcast(targets)))
    last_first = Window.partitionBy(*map(quoted, r.keys), "_piece").orderBy(*[quoted(c).desc() for c in r.order])
    tails = join_keys(r.rows, spanning, [*r.keys, "_piece"]).withColumn("_back", F.row_number().over(last_first)).where(F.col("_back") <= depth)
    at = F.col("_start") + F.col("_rows") - F.col("_back")
    # Every segment has a row, so the next ``depth`` ones are all that can reach back to here.
    nearest = F.slice("_targets", F.array_position(F.transform("_targets", lambda t: t["_piece"]), F.col("_piece")).cast("int") + 1, depth)
    needing = F.filter(nearest, lambda t: (t["_start"] > at) & (t["_start"] <= at + depth))
    return tails.withColumn("_for", F.explode(F.transform(needing, lambda t: t["_piece"]))).select(
        *[quoted(c) for c in r.rows.columns if c != "_piece"], F.col("_for").alias("_piece")
    )


def sliding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int, columns: Callable[[WindowSpec], dict[str, Column]]
) -> DataFrame:
    """Add window columns that look back at most ``depth`` rows, the current one not counted.

    ``columns`` gets the window (ordered, without a frame) and returns the new columns.
    """
    r = deal(df, keys, order)
    if depth > 0:
        both = r.rows.withColumn("_halo", F.lit(False)).unionByName(_halos(r, depth).withColumn("_halo", F.lit(True)))
    else:
        both = r.rows.withColumn("_halo", F.lit(False))
    made = columns(r.inside)
    return both.withColumns(made).where(~F.col("_halo")).select(*[quoted(c) for c in df.columns if c not in made], *map(quoted, made))


def with_mid_ranks(df: DataFrame, value: str, spread: str, weight: str, name: str) -> DataFrame:
    """Add the average rank (from 1) of ``value`` among all rows, each counted ``weight`` times.

    Ranges are cut by (value, spread), so a hot value spans as many as its share, and no row moves to the key of its value.
    Values that stand in several ranges are the first or last of a range; their ranks come from a table of these.
    """
    rows, _, _ = with_chunks(df, [value], [spread])
    v, w = quoted(value), quoted(weight)
    edges = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    totals = rows.groupBy("_piece").agg(F.sum(w).alias("_w"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_w").over(edges), F.lit(0)))
    ends = totals.select(F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_edge")).distinct()
    # Two values per range at most: how often each occurs, and how many lie before it.  A value that goes on into the next
    # range is the largest of its first one; any other edge value has only smaller ranges before it.
    shared = rows.join(F.broadcast(ends), v == F.col("_edge")).groupBy("_edge", "_piece").agg(F.sum(w).alias("_c")).join(F.broadcast(totals), "_piece")
    smaller = F.when(F.col("_edge") == F.col("_hi"), F.col("_before") + F.col("_w") - F.col("_c")).otherwise(F.col("_before"))
    shared = shared.groupBy("_edge").agg(F.sum("_c").alias("_count"), F.min_by(smaller, "_piece").alias("_less"))
    inside = Window.partitionBy("_piece").orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(w).over(Window.partitionBy("_piece", v))
    placed = rows.join(F.broadcast(totals.select("_piece", "_before")), "_piece").withColumns({"_upto": F.sum(w).over(inside), "_own": own})
    placed = placed.join(F.broadcast(shared), v == F.col("_edge"), "left")
    less = F.coalesce("_less", F.col("_before") + F.col("_upto") - F.col("_own"))
    count = F.coalesce("_count", "_own")
    return placed.withColumn(name, less + (count + 1) / 2.0).select(*map(quoted, df.columns), name)


# --- ranges of a number ---------------------------------------------------------------------


@dataclass(frozen=True)
class Cuts:
    """Cut points in order, and those among them that are values heavier than a range."""

    points: tuple[float, ...]
    heavy: tuple[float, ...]


def cut_sketch(df: DataFrame, value: str) -> Column:
    """Aggregate over a column of doubles for :func:`cuts_of`: ranges with about as many rows each, by a sketch of all rows.

    Any cut is correct, a poor one is only slower.  The driver holds one number per range.
    """
    ranges = range_count(df)
    n = max(ranges, min(1024, 4 * ranges))
    return F.percentile_approx(quoted(value), [i / n for i in range(1, n)], 10 * n)


def cuts_of(found: Sequence[float] | None) -> Cuts:
    """Cut points from the sketch, null without values."""
    found = found or ()
    return Cuts(tuple(sorted(set(found))), tuple(sorted({a for a, b in pairwise(found) if a == b})))


def _is_heavy(value: str, cuts: Cuts) -> Column:
    return quoted(value).isin(list(cuts.heavy)) if cuts.heavy else F.lit(False)


def with_range(df: DataFrame, value: str, cuts: Cuts, name: str = "_range") -> DataFrame:
    """Number the ranges, monotone in the value: ``2i + 1`` holds a heavy cut alone, ``2i`` what lies between it and the cut before.

    Found by halving.  Filter on the value, not on the number: a filter on it would copy the steps once per step.
    """
    points, step = F.lit(list(cuts.points)).cast("array<double>"), 1 << len(cuts.points).bit_length() >> 1
    out = df.withColumn(name, F.lit(0))
    while step:
        at = F.col(name)
        out = out.withColumn(name, F.when(F.get(points, at + (step - 1)) < quoted(value), at + step).otherwise(at))
        step >>= 1
    return out.withColumn(name, 2 * F.col(name) + _is_heavy(value, cuts).cast("int"))


def medians(df: DataFrame, by: str, value: str, cuts: Cuts) -> DataFrame:
    """Exact median of a column of doubles in every group: ``by, q_0``.

    Rows are counted per group and range; only those in the ranges that hold the middle are merged and sorted.
    """
    rows = df.select(quoted(by), quoted(value).alias("_v"), F.lit(1).alias("_c"))
    # One or two rows per group.
    wanted = cut_lineage(wanted_ranges(with_range(rows, "_v", cuts), [0.5], [by]))
    ends = wanted.agg(F.min("_range"), F.max("_range")).first()
    if ends[0] is not None:  # what lies beyond all of them needs no look at its range
        edges = [None, *cuts.points, None]
        low, high = edges[ends[0] // 2], edges[ends[1] // 2 + 1]
        rows = rows.where(F.lit(True) if low is None else F.col("_v") >= low).where(F.lit(True) if high is None else F.col("_v") <= high)
    picked = join_keys(with_range(rows, "_v", cuts), F.broadcast(wanted), [by, "_range"])
    merged = picked.groupBy(quoted(by), "_range", "_v", "_off", "_n").agg(F.sum("_c").alias("_c"))
    return quantiles_in(merged, [0.5], [by])


def with_ranks(df: DataFrame, value: str, rank: str, ties: str, cuts: Cuts, weight: str | None = None) -> DataFrame:
    """Add the average rank (from 1) of a column of doubles without nulls among all rows, and how many rows share the value.

    ``weight`` names the number of rows that a row stands for.  Ranges are counted; the rows of a heavy value get what follows
    from the counts, the others are sorted inside their range.  The driver holds two numbers per range.
    """
    w = quoted(weight) if weight else F.lit(1)
    dealt = with_range(df, value, cuts)
    sizes = {r["_range"]: float(r["_w"]) for r in dealt.groupBy("_range").agg(F.sum(w).alias("_w")).collect()}
    of_range = [sizes.get(i, 0.0) for i in range(2 * len(cuts.points) + 1)]
    before = F.get(F.lit([0.0, *accumulate(of_range)][:-1]), F.col("_range"))
    own = F.get(F.lit(of_range), F.col("_range"))
    heavy = _is_heavy(value, cuts)
    made = []
    if any(sizes.get(i, 0) for i in range(0, len(of_range), 2)):
        inside = Window.partitionBy("_range").orderBy(quoted(value))
        upto = F.sum(w).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        less = upto - F.sum(w).over(inside.rangeBetween(Window.currentRow, Window.currentRow)) if weight else F.rank().over(inside) - 1
        light = dealt.where(~heavy).withColumns({"_upto": upto, "_less": less})
        count = F.col("_upto") - F.col("_less")
        made.append((light, before + F.col("_less") + (count + 1) / 2.0, count.cast("double")))
    if cuts.heavy or not made:
        made.append((dealt.where(heavy), before + (own + 1) / 2.0, own))
    parts = [part.select(*map(quoted, df.columns), r.alias(rank), c.alias(ties)) for part, r, c in made]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
