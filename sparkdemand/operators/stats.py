"""Hypothesis tests from aggregated moments and ranks.

The data is reduced on the cluster over all rows (no samples); only the few resulting numbers reach the
driver, where the tail probabilities are looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.functions import special, tails
from sparkdemand.functions.columns import (
    ANALYSIS_DISCOUNT_WORDS,
    ANALYSIS_HOLIDAY_WORDS,
    EPS,
    TEST_HOLIDAY_WORDS,
    is_truthy,
    quoted,
)
from sparkdemand.operators.clean import to_number
from sparkdemand.operators.eda import rank_correlation, spearman
from sparkdemand.operators.order import join_salted
from sparkdemand.operators.ranges import Cuts, cut_sketch, cuts_of, medians, with_mid_ranks, with_ranks
from sparkdemand.session import cut_lineage

# Verdict texts.
SIGNIFICANT = "Reject H0 (Statistically Significant)"
NOT_SIGNIFICANT = "Fail to Reject H0 (Not Significant)"


def _grouped(df: DataFrame, group: Column, value: str) -> DataFrame:
    return df.select(group.alias("g"), to_number(df, value).alias("x")).where("g is not null and x is not null")


def two_group_statistics(df: DataFrame, flag: Column, value: str, minimum: int = 5) -> DataFrame:
    """One row: sizes, means, variances, Student and Welch t with degrees of freedom.

    Empty when a side has fewer than ``minimum`` rows.
    """
    sides = _grouped(df, flag, value).groupBy("g").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")
    )

    def side(on: bool, c: str) -> Column:
        return F.max(F.when(F.col("g") == on, F.col(c)))

    row = sides.agg(*[side(on, c).alias(f"{c}_{tag}") for on, tag in ((True, "on"), (False, "off")) for c in ("n", "mean", "var")])
    n1, n0, m1, m0, v1, v0 = (F.col(c) for c in ("n_on", "n_off", "mean_on", "mean_off", "var_on", "var_off"))
    pooled = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
    e1, e0 = v1 / n1, v0 / n0
    return row.where((n1 >= minimum) & (n0 >= minimum)).select(
        "n_on", "n_off", "mean_on", "mean_off", "var_on", "var_off",
        F.try_divide(m1 - m0, F.sqrt(pooled * (1 / n1 + 1 / n0))).alias("t_student"),
        (n1 + n0 - 2).cast("double").alias("df_student"),
        F.try_divide(m1 - m0, F.sqrt(e1 + e0)).alias("t_welch"),
        F.try_divide((e1 + e0) * (e1 + e0), e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)).alias("df_welch"),
        ((m1 - m0) / F.greatest(m0, F.lit(EPS)) * 100.0).alias("diff_pct"),
    )


def two_group_tests(df: DataFrame, by: Sequence[str], flag: Column, value: str, minimum: int = 5) -> DataFrame:
    """Mean comparison with and without the flag in every group of ``by``, as rows: sizes, means, t, degrees and p of both tests.

    Groups with fewer than ``minimum`` rows on a side are left out.  One aggregation, p-values as expressions.
    """
    work = df.select(*map(quoted, by), flag.alias("_on"), to_number(df, value).alias("_x")).where("_on IS NOT NULL AND _x IS NOT NULL")
    sides = {"on": F.col("_on"), "off": ~F.col("_on")}
    made = [f(F.when(on, F.col("_x"))).alias(f"{name}_{tag}") for tag, on in sides.items() for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    row = work.groupBy(*map(quoted, by)).agg(*made).where((F.col("n_on") >= minimum) & (F.col("n_off") >= minimum))
    n1, n0, m1, m0, v1, v0 = (F.col(c) for c in ("n_on", "n_off", "mean_on", "mean_off", "var_on", "var_off"))
    pooled = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
    e1, e0 = v1 / n1, v0 / n0
    tested = row.select(
        *map(quoted, by), "n_on", "n_off", "mean_on", "mean_off",
        F.try_divide(m1 - m0, F.sqrt(pooled * (1 / n1 + 1 / n0))).alias("t_student"),
        (n1 + n0 - 2).cast("double").alias("df_student"),
        F.try_divide(m1 - m0, F.sqrt(e1 + e0)).alias("t_welch"),
        F.try_divide((e1 + e0) * (e1 + e0), e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)).alias("df_welch"),
    )
    return tested.withColumns({f"p_{k}": tails.t_tail(F.col(f"t_{k}"), F.col(f"df_{k}")) for k in ("student", "welch")})


def with_f_p(statistics: DataFrame) -> DataFrame:
    """Add ``p`` to the rows of :func:`anova` or :func:`levene`."""
    return statistics.withColumn("p", tails.f_tail(F.col("f"), F.col("df_between"), F.col("df_within")))


def with_h_p(statistics: DataFrame) -> DataFrame:
    """Add ``p`` to the rows of :func:`kruskal`."""
    return statistics.withColumn("p", tails.chi2_tail(F.col("h"), F.col("df")))


def with_correlation_p(statistics: DataFrame) -> DataFrame:
    """Add ``p_pearson`` and ``p_spearman`` to the rows of :func:`correlation_statistics`."""
    return statistics.withColumns({f"p_{k}": tails.correlation_p(F.col(k), F.col("n")) for k in ("pearson", "spearman")})


def group_moments(df: DataFrame, group: Column, value: str) -> DataFrame:
    """One row per group, written down: ``g, n, m, v, s, k`` (rows, mean, variance, skewness, kurtosis)."""
    x = F.col("x")
    made = {"n": F.count(x), "m": F.avg(x), "v": F.var_pop(x), "s": F.skewness(x), "k": F.kurtosis(x)}
    return cut_lineage(_grouped(df, group, value).groupBy("g").agg(*[c.alias(name) for name, c in made.items()]))


def _between_within(per: DataFrame, minimum: int) -> DataFrame:
    """F ratio over the groups with at least ``minimum`` rows, from ``n``, ``m`` and ``v`` of each."""
    per = per.where(F.col("n") >= minimum)
    grand = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    gap = F.col("m") - F.col("grand")
    sums = per.crossJoin(F.broadcast(grand)).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    k, n = F.col("groups"), F.col("n")
    return sums.where(k >= 2).select(
        k.alias("k"),
        "n",
        F.try_divide(F.col("between") / (k - 1), F.col("within") / (n - k)).alias("f"),
        (k - 1).cast("double").alias("df_between"),
        (n - k).cast("double").alias("df_within"),
    )


def _moments_of(work: DataFrame) -> DataFrame:
    """``n``, ``m`` and ``v`` of every group, written down: one row per group, read twice."""
    return cut_lineage(work.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")))


def anova(df: DataFrame, group: str, value: str, minimum: int = 5, moments: DataFrame | None = None) -> DataFrame:
    """One-way analysis of variance: ``k, n, f, df_between, df_within``.

    ``moments`` are those of :func:`group_moments`, where they are there already.
    """
    return _between_within(_moments_of(_grouped(df, quoted(group), value)) if moments is None else moments, minimum)


def levene(df: DataFrame, group: Column, value: str, minimum: int = 1, cuts: Cuts | None = None) -> DataFrame:
    """Median-centred Levene test: the F ratio of the distances from the group medians.

    ``cuts`` are cut points of the value, where they are there already.
    """
    work = _grouped(df, group, value)
    if cuts is None:
        cuts = cuts_of(work.agg(cut_sketch(work, "x")).first()[0])
    middle = medians(work, "g", "x", cuts)  # one row per group
    spread = work.join(F.broadcast(middle), "g").select("g", F.abs(F.col("x") - F.col("q_0")).alias("x"))
    return _between_within(_moments_of(spread), minimum)


def _h_statistic(per: DataFrame, pool: DataFrame) -> DataFrame:
    """Tie-corrected H from ``n`` and ``mean_rank`` of each group, and one row with ``total`` and ``ties``."""
    t, gap = F.col("total"), F.col("mean_rank") - (F.col("total") + 1) / 2
    return (
        per.crossJoin(F.broadcast(pool))
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
            F.sum(12.0 / (t * (t + 1)) * F.col("n") * gap * gap).alias("raw"),
            F.max(1 - F.col("ties") / (t * t * t - t)).alias("correction"),
        )
        .where(F.col("k") >= 2)
        .select("k", "n", F.try_divide("raw", "correction").alias("h"), (F.col("k") - 1).cast("double").alias("df"))
    )


def kruskal(df: DataFrame, group: str, value: str, minimum: int = 5, ranked: DataFrame | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction: ``k, n, h, df``.

    Rows are merged to (group, value) counts; ranks are taken inside ranges of the values.  ``ranked`` are the rows of
    exactly the groups with ``minimum`` rows, with ranks ``rx``, the ``ties`` of their values and the ``w`` rows each stands for,
    where they are there already.
    """
    if ranked is not None:
        w, c = F.col("w"), F.col("ties")
        sums = [F.sum(w).alias("n"), (F.sum(w * F.col("rx")) / F.sum(w)).alias("mean_rank"), F.sum(w * (c * c - 1)).alias("ties")]
        per = cut_lineage(ranked.groupBy(quoted(group).alias("g")).agg(*sums))
        return _h_statistic(per.drop("ties"), per.agg(F.sum("n").cast("double").alias("total"), F.sum("ties").alias("ties")))
    work = _grouped(df, quoted(group), value)
    counts = work.groupBy("g", F.col("x").alias("_v")).agg(F.count(F.lit(1)).alias("w"))
    large = counts.groupBy("g").agg(F.sum("w").alias("n")).where(F.col("n") >= minimum).select("g")
    ranked = with_mid_ranks(join_salted(counts, large, "g", "_v"), "_v", "g", "w", "rank")
    per = ranked.groupBy("g").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("rank")) / F.sum("w")).alias("mean_rank"))
    values = ranked.groupBy("_v").agg(F.sum("w").cast("double").alias("c"))
    c = F.col("c")
    return _h_statistic(per, values.agg(F.sum("c").alias("total"), F.sum(c * c * c - c).alias("ties")))


def normality(df: DataFrame, group: Column, value: str, minimum: int = 8, moments: DataFrame | None = None) -> DataFrame:
    """Jarque-Bera per group: ``g, n, jb, p`` (chi-square with two degrees has p = exp(-jb/2)).

    ``moments`` are those of :func:`group_moments`, where they are there already.
    """
    if moments is None:
        made = F.count("x").alias("n"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k")
        moments = _grouped(df, group, value).groupBy("g").agg(*made)
    s, k = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0.0))
    jb = F.col("n") / 6.0 * (s * s + k * k / 4.0)
    return moments.where(F.col("n") >= minimum).select("g", "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def all_normal(df: DataFrame, group: Column, value: str, alpha: float, moments: DataFrame | None = None) -> bool:
    """True when no group (or no group large enough to judge) rejects normality."""
    row = normality(df, group, value, moments=moments).agg(F.min("p").alias("p")).first()
    return row["p"] is None or row["p"] > alpha


def correlation_statistics(df: DataFrame, x: str, y: str, ranked: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """``n, pearson, spearman`` over the rows with both values.

    ``ranked`` are exactly these rows with ranks ``rx`` and ``ry`` and the ``w`` rows each stands for, and ``pairs`` is one row
    with ``n`` and ``pearson``, where they are there already.
    """
    both = df.select(to_number(df, x).alias("x"), to_number(df, y).alias("y")).where("x is not null and y is not null")
    pearson = both.agg(F.corr("x", "y").alias("pearson"), F.count(F.lit(1)).alias("n")) if pairs is None else pairs
    ranks = spearman(both, "x", "y") if ranked is None else rank_correlation(ranked, pearson.select("n"))
    return ranks.crossJoin(F.broadcast(pearson.select("pearson"))).select("n", "pearson", "spearman")


def verdict(p: float, alpha: float = 0.05) -> str:
    return SIGNIFICANT if p < alpha else NOT_SIGNIFICANT


def verdict_column(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, SIGNIFICANT).otherwise(NOT_SIGNIFICANT)


# --- the report ---------------------------------------------------------------------------------

RESULT_SCHEMA = (
    "test_id string, hypothesis string, test_used string, statistic double, p_value double, alpha double, "
    "verdict string, summary string"
)


def compare_two_groups(
    df: DataFrame, flag: Column, value: str, alpha: float = 0.05, minimum: int = 5, one_sided: bool = False, cuts: Cuts | None = None
) -> dict | None:
    """Mean comparison: Student when Levene keeps equal variances, Welch otherwise.

    ``one_sided`` tests "larger when flagged" and always uses Welch.
    """
    row = two_group_statistics(df, flag, value, minimum).first()
    if row is None or row["t_welch"] is None:
        return None
    spread = levene(df, flag, value, cuts=cuts).first()
    p_var = special.f_tail(spread["f"], spread["df_between"], spread["df_within"]) if spread and spread["f"] is not None else 0.0
    equal = p_var > alpha and not one_sided
    t, dof = (row["t_student"], row["df_student"]) if equal else (row["t_welch"], row["df_welch"])
    p = special.t_tail_greater(t, dof) if one_sided else special.t_tail(t, dof)
    return {**row.asDict(), "t": t, "df": dof, "p": p, "p_levene": p_var, "equal_var": equal}


def _two_group_record(df, flag, value, alpha, minimum, test_id, hypothesis, on_name, off_name, cuts) -> tuple | None:
    r = compare_two_groups(df, flag, value, alpha, minimum, cuts=cuts)
    if r is None:
        return None
    used = ("Student's" if r["equal_var"] else "Welch's") + " Two-Sample t-test"
    text = (
        f"{on_name} averaged {r['mean_on']:,.2f} vs {r['mean_off']:,.2f} on {off_name} ({r['diff_pct']:+.1f}% difference); "
        f"{'statistically significant' if r['p'] < alpha else 'not statistically significant'}."
    )
    return test_id, hypothesis, used, round(r["t"], 4), r["p"], alpha, verdict(r["p"], alpha), text


class _Sales:
    """The rows of a report, held: sales ``x``, orders ``o``, groups; and the ranks of the sales, made when a test wants them.

    Tests that use every row with sales share the ranks; any other rows are ranked by themselves.
    """

    def __init__(self, rows: DataFrame, others: Sequence[str]) -> None:
        self.rows, self.others, self.held = rows.persist(StorageLevel.MEMORY_AND_DISK), others, [rows]
        self.sold = rows.where("x IS NOT NULL")
        different = F.approx_count_distinct(F.xxhash64("x", *others)).alias("different")
        found = self.sold.agg(F.count(F.lit(1)).alias("all"), different, cut_sketch(rows, "x").alias("cuts")).first()
        self.cuts = cuts_of(found["cuts"])
        self.all_sold = found["all"]
        self.repeated = found["all"] >= 4 * found["different"]
        self.whole: DataFrame | None = None

    def ranked(self, column: str, used: int, large: DataFrame | None = None) -> DataFrame:
        """Rows that have the column (a group of ``large``) with ranks; ``used`` is their number."""
        if used == self.all_sold:
            if self.whole is None:
                self.whole = self._rank(self.sold, self.others)
            return self.whole
        rows = self.sold.where(F.col(column).isNotNull())
        if large is not None:
            rows = rows.join(F.broadcast(large.select(F.col("g").alias(column))), column, "left_semi")  # one row per group
        return self._rank(rows, [column])

    def with_both_ranks(self, used: int) -> DataFrame:
        """The rows with sales and orders, ranked by both."""
        rows = self.ranked("o", used)
        cuts = cuts_of(rows.agg(cut_sketch(rows, "o")).first()[0])
        return with_ranks(rows, "o", "ry", "_ties", cuts, "w").select("rx", "ry", "w")

    def _rank(self, rows: DataFrame, others: Sequence[str]) -> DataFrame:
        """Sales and other columns with ranks of the sales ``rx``, the ``ties`` of their values and the ``w`` rows each stands for.

        Where the sketch found four equal rows to one different row, equal rows are merged before they are sorted.
        """
        rows = rows.select("x", *others)
        if not self.repeated:
            return self._hold(with_ranks(rows, "x", "rx", "ties", self.cuts).withColumn("w", F.lit(1)))
        merged = self._hold(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("w")))
        return self._hold(with_ranks(merged, "x", "rx", "ties", self.cuts, "w"))

    def _hold(self, rows: DataFrame) -> DataFrame:
        self.held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    def close(self) -> None:
        for rows in self.held:
            rows.unpersist()


def _group_record(held: _Sales, column: str, group: str, alpha: float, max_groups: int | None, minimum: int = 5) -> tuple | None:
    df = held.rows
    moments = group_moments(df, F.col(column), "x")
    f_row = anova(df, column, "x", minimum, moments).first()
    if f_row is None or (max_groups is not None and f_row["k"] > max_groups):
        return None
    if all_normal(df, F.col(column), "x", alpha, moments):
        used, stat = "One-Way ANOVA", f_row["f"]
        p = special.f_tail(stat, f_row["df_between"], f_row["df_within"]) if stat is not None else float("nan")
    else:
        ranked = held.ranked(column, f_row["n"], moments.where(F.col("n") >= minimum))
        h_row = kruskal(df, column, "x", minimum, ranked).first()
        used, stat = "Kruskal-Wallis H-Test", h_row["h"]
        p = special.chi2_tail(stat, h_row["df"]) if stat is not None else float("nan")
    if stat is None:
        return None
    text = (
        f"Evaluated {f_row['k']} {group} groups using {used}: "
        f"{'significant variation' if p < alpha else 'no statistically significant variation'} in sales."
    )
    hyp = f"Sales distribution is uniform across all {group} categories."
    return f"{group}_variation", hyp, used, round(stat, 4), p, alpha, verdict(p, alpha), text


def _correlation_record(held: _Sales, alpha: float) -> tuple | None:
    df = held.rows
    both = F.when(F.col("x").isNotNull() & F.col("o").isNotNull(), 1)
    made = [f(c).alias(f"{name}_{c}") for c in ("x", "o") for name, f in (("n", F.count), ("s", F.skewness), ("k", F.kurtosis))]
    pairs = cut_lineage(df.agg(F.count(both).alias("n"), F.corr("o", "x").alias("pearson"), *made))  # one row
    n = pairs.first()["n"]
    if n < 10:
        return None
    row = correlation_statistics(df, "o", "x", held.with_both_ranks(n), pairs).first()
    if row is None or row["pearson"] is None:
        return None
    moments = {c: pairs.select(F.lit(c).alias("g"), *[F.col(f"{name}_{c}").alias(name) for name in "nsk"]) for c in ("x", "o")}
    normal = all(all_normal(df, F.lit(c), c, alpha, moments[c]) for c in ("x", "o"))
    used, r = ("Pearson Correlation", row["pearson"]) if normal else ("Spearman Rank Correlation", row["spearman"])
    p = special.correlation_p(r, row["n"])
    text = f"Pearson r = {row['pearson']:+.4f}, Spearman rho = {row['spearman']:+.4f} over {row['n']:,} pairs ({used})."
    hyp = "There is no correlation between order volume and sales revenue."
    return "orders_sales_correlation", hyp, used, round(r, 4), p, alpha, verdict(p, alpha), text


def run_tests(
    df: DataFrame,
    sales: str = "Sales",
    order: str | None = None,
    discount: str | None = None,
    holiday: str | None = None,
    groups: Sequence[str] = (),
    alpha: float = 0.05,
    holiday_minimum: int = 5,
    holiday_decimal_flag: bool = False,
    max_groups: int | None = None,
) -> DataFrame:
    """All applicable tests, one row each.  Columns that are missing are skipped; under ten rows nothing runs.

    ``holiday_minimum=4``, ``holiday_decimal_flag=True`` and ``max_groups=60`` select the second published
    variant of the rules (it also reads "1.0" as a holiday).
    """
    has = lambda c: bool(c) and c in df.columns
    if not has(sales):
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    holiday_words = ANALYSIS_HOLIDAY_WORDS if holiday_decimal_flag else TEST_HOLIDAY_WORDS
    columns = {"x": to_number(df, sales)}
    columns |= {"o": to_number(df, order)} if has(order) else {}
    columns |= {"discounted": is_truthy(quoted(discount), ANALYSIS_DISCOUNT_WORDS)} if has(discount) else {}
    columns |= {"holiday": is_truthy(quoted(holiday), holiday_words)} if has(holiday) else {}
    group_names = {f"g{i}": g for i, g in enumerate(g for g in groups if has(g))}
    columns |= {c: quoted(g) for c, g in group_names.items()}
    # Every test reads the rows several times; what makes them (joins of the fact table) runs once.
    held = _Sales(df.select(*[c.alias(name) for name, c in columns.items()]), [c for c in columns if c == "o" or c in group_names])
    try:
        records = _test_records(held, group_names, alpha, holiday_minimum, max_groups)
    finally:
        held.close()
    return df.sparkSession.createDataFrame([r for r in records if r is not None], RESULT_SCHEMA)


def _test_records(held: _Sales, group_names: dict[str, str], alpha: float, holiday_minimum: int, max_groups: int | None) -> list[tuple | None]:
    df, records = held.rows, []
    if held.all_sold < 10:
        return records
    if "discounted" in df.columns:
        hyp = "Mean sales on discounted days equals mean sales on other days."
        names = "discount_impact", hyp, "Discounted rows", "other rows"
        records.append(_two_group_record(df, F.col("discounted"), "x", alpha, 5, *names, held.cuts))
    if "holiday" in df.columns:
        hyp = "Mean sales on holidays equals mean sales on regular days."
        names = "holiday_effect", hyp, "Holidays", "regular days"
        records.append(_two_group_record(df, F.col("holiday"), "x", alpha, holiday_minimum, *names, held.cuts))
    records += [_group_record(held, column, name, alpha, max_groups) for column, name in group_names.items()]
    if "o" in df.columns:
        records.append(_correlation_record(held, alpha))
    return records
