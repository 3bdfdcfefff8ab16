"""Chronological splits and expanding-window folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdemand.functions.columns import quoted
from sparkdemand.operators.order import repeat_rows, with_chunks, with_row_index
from sparkdemand.operators.ranges import is_long, with_positions

MIN_DATES = 10


@dataclass(frozen=True)
class Split:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    info: DataFrame
    cuts: tuple


def split_cuts(df: DataFrame, date: str, train_pct: float, val_pct: float) -> tuple[int, object, object]:
    """Number of distinct dates and the first validation and test date.

    The distinct dates (time stamps: in ranges) are ranked on the cluster; two of them come back and turn into literals,
    so the split filters can be pushed into the scan.
    """
    days = df.select(F.col(date).alias("d")).where("d is not null").distinct()
    n = days.count()
    if n < MIN_DATES:
        return n, None, None
    picks = int(n * train_pct), int(n * (train_pct + val_pct))
    if is_long(days, "d"):
        ranked = with_positions(days, [], ["d"], "i")
    else:
        ranked = days.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")) - 1)
    found = {r["i"]: r["d"] for r in ranked.where(F.col("i").isin(*picks)).collect()}
    return n, found.get(picks[0]), found.get(picks[1])


def split_info(train: DataFrame, val: DataFrame, test: DataFrame, date: str) -> DataFrame:
    """Per part: first date, last date and rows."""
    parts = [p.select(F.lit(i).alias("pos"), F.lit(name).alias("part"), F.col(date).cast("date").alias("d"))
             for i, (name, p) in enumerate((("train", train), ("val", val), ("test", test)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("pos", "part").agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("rows")
    )


def fixed_date_split(df: DataFrame, val_from, test_from, date: str = "Date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before ``val_from``, between, and from ``test_from`` on."""
    d = F.col(date)
    lo, hi = F.lit(val_from).cast("date"), F.lit(test_from).cast("date")
    return df.where(d < lo), df.where((d >= lo) & (d < hi)), df.where(d >= hi)


def _by_position(df: DataFrame, date: str, train_pct: float, val_pct: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split by row position for tables with very few dates.

    Equal rows are merged with a count first, so a crowd of copies occupies an interval of positions
    without ever being ordered one by one; a cut inside the interval hands out the right number of copies.
    """
    cols = df.columns
    packed = df.groupBy(*map(quoted, cols)).agg(F.count(F.lit(1)).alias("_m"))
    work, _, order = with_chunks(packed, [date], None)
    sizes = work.groupBy("_piece").agg(F.sum("_m").alias("_rows"))
    everything = Window.partitionBy(F.lit(0))  # one row per range
    before = everything.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_piece",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    upto = Window.partitionBy("_piece").orderBy(quoted(date), *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = work.join(F.broadcast(offsets), "_piece").withColumn("_end", F.col("_off") + F.sum("_m").over(upto))
    start, end, n = F.col("_end") - F.col("_m"), F.col("_end"), F.col("_total")
    a, b = F.floor(n * F.lit(train_pct)), F.floor(n * F.lit(train_pct + val_pct))
    out = []
    for lo, hi in ((F.lit(0), a), (a, b), (b, n)):
        copies = F.greatest(F.lit(0), F.least(end, hi) - F.greatest(start, lo)).cast("long")
        out.append(repeat_rows(placed.select(*map(quoted, cols), copies.alias("_times")), "_times"))
    return tuple(out)


def chronological_split(df: DataFrame, date: str = "Date", train_pct: float = 0.70, val_pct: float = 0.15) -> Split:
    """Train, validation and test by distinct dates; by row position when there are fewer than ten dates."""
    n, train_cut, val_cut = split_cuts(df, date, train_pct, val_pct)
    if n < MIN_DATES:
        parts = _by_position(df, date, train_pct, val_pct)
    else:
        d = F.col(date)
        a, b = F.lit(train_cut), F.lit(val_cut)
        parts = df.where(d < a), df.where((d >= a) & (d < b)), df.where(d >= b)
    return Split(*parts, split_info(*parts, date), (train_cut, val_cut))


# --- expanding-window folds ---------------------------------------------------------------------


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """Test interval of each fold over positions 0..n-1; training is everything before it."""
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {k} folds")
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


def fold_sizes(df: DataFrame, date: str, k: int = 3, tie: Sequence[str] | None = None) -> DataFrame:
    """Per fold: training rows, test rows and the first and last test date."""
    placed = with_row_index(df, date, tie, "_pos")
    n = placed.count()
    rows = None
    for i, (lo, hi) in enumerate(fold_bounds(n, k)):
        part = placed.agg(
            F.lit(i).alias("fold"),
            F.count_if(F.col("_pos") < lo).alias("train_rows"),
            F.count_if(F.col("_pos").between(lo, hi - 1)).alias("test_rows"),
            F.min(F.when(F.col("_pos").between(lo, hi - 1), F.col(date))).alias("first_test_date"),
            F.max(F.when(F.col("_pos").between(lo, hi - 1), F.col(date))).alias("last_test_date"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def expanding_folds(placed: DataFrame, n: int, k: int = 3, pos: str = "_pos") -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) pairs of a frame that carries row positions."""
    for lo, hi in fold_bounds(n, k):
        yield placed.where(F.col(pos) < lo), placed.where(F.col(pos).between(lo, hi - 1))
