"""Table profiling as aggregations.

Wide profiles are one pass: every column's statistic is computed in a single
aggregate and then unpivoted, instead of one job per column. Scalars that a
later step needs (min, max, a percentile, a total) are one-row aggregates
read back as scalar subqueries: computed once, inlined, never joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.operators.encoders import quantile_row, scalar_row
from lendwise.operators.ordering import rank_quantiles


def _long(df: DataFrame, cols: Sequence[str], value_type: str = "string") -> DataFrame:
    """(column, value) pairs of ``cols`` (an unpivot that keeps NULL values)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value")) for c in cols])
    return df.select(F.inline(pairs))


def null_pct(df: DataFrame, cols: Sequence[str] | None = None, places: int = 2) -> DataFrame:
    """Percentage of NULLs per column, one pass, one row per column."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")) * 100.0, places).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_pct")) for c in cols])))


def null_fraction(df: DataFrame, col: str) -> DataFrame:
    """Fraction of NULLs in one column."""
    return df.agg(F.avg(F.col(col).isNull().cast("double")).alias("null_fraction"))


def predicate_fraction(df: DataFrame, pred: Column, name: str = "fraction") -> DataFrame:
    """Share of rows where ``pred`` holds; a NULL comparison counts as false."""
    return df.agg(F.avg(F.coalesce(pred, F.lit(False)).cast("double")).alias(name))


def shape(df: DataFrame, id_col: str, approx: bool = False) -> DataFrame:
    """Row count, column count, distinct ids, non-null ids."""
    distinct = F.approx_count_distinct(id_col) if approx else F.count_distinct(F.col(id_col))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        distinct.alias("n_distinct_ids"),
        F.count(F.col(id_col)).alias("n_ids"),
    )


def value_counts(df: DataFrame, col: str, places: int = 6, sort: str | None = None) -> DataFrame:
    """Count per non-null value and its percentage of the non-null total.

    The total is a one-row aggregate of the same grouped result (the
    exchange is reused), read as a scalar subquery. F8: ``sort="count"``
    orders by count descending (value as tie-break), ``sort="key"`` by value.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).select("t").scalar()
    out = counts.select(col, "count", F.round(F.col("count") * 100.0 / total, places).alias("pct"))
    if sort == "count":
        return out.orderBy(F.desc("count"), F.asc(col))
    if sort == "key":
        return out.orderBy(col)
    return out


def value_counts_many(df: DataFrame, cols: Sequence[str], places: int = 6) -> DataFrame:
    """A9 over many columns at once: unpivot to (column, value), one group-by.

    Per-column totals are a second, tiny aggregate of the counts (one row
    per column) joined back on the column name.
    """
    counts = (
        _long(df, cols).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy("column").agg(F.sum("count").alias("__total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "count", F.round(F.col("count") * 100.0 / F.col("__total"), places).alias("pct")
    )


def top_categories(df: DataFrame, col: str, k: int = 20, places: int = 6) -> DataFrame:
    """the ``k`` most frequent values; pct over **all** rows (NULLs in the denominator).

    Ties on the count are broken by the value so the cut is deterministic.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).where(F.col(col).isNotNull())
    rows = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    top = counts.orderBy(F.desc("count"), F.asc(col)).limit(k)
    return top.select(col, "count", F.round(F.col("count") * 100.0 / rows, places).alias("pct"))


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True, places: int = 6) -> DataFrame:
    """A10: count, mean, std (n−1), min, 25/50/75 % (linear interpolation), max per column.

    The columns are unpivoted to (column, value) once; moments come from one
    grouped aggregate, exact quartiles from bracket and refine
    (:func:`~lendwise.operators.ordering.rank_quantiles`) or, with
    ``exact=False``, ``percentile_approx``. One row per column.
    """
    long = _long(df, cols, "double")
    v = F.col("value")
    moments = long.groupBy("column").agg(
        F.count(v).alias("count"),
        F.round(F.avg(v), places).alias("mean"),
        F.round(F.stddev_samp(v), places).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    if exact:
        quart = rank_quantiles(long, "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], by=["column"], few_groups=True)
    else:
        qa = F.percentile_approx(v, [0.25, 0.5, 0.75], 100000)
        quart = long.groupBy("column").agg(qa.alias("__q")).select(
            "column", F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"))
    quart = quart.select("column", *[F.round(c, places).alias(c) for c in ("p25", "p50", "p75")])
    out = moments.join(quart, "column", "left")
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def clip_at_quantile(df: DataFrame, col: str, q: float = 0.99, exact: bool = True) -> DataFrame:
    """keep rows whose value is ≤ the column's own ``q`` quantile (NULLs drop out)."""
    cut = quantile_row(df, [col], q, exact=exact).select(col).scalar()
    return df.where(F.col(col) <= cut)


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop rows with a NULL in any listed column."""
    return df.na.drop(how="any", subset=list(cols))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by an explicit order (``n ≤ 0`` keeps all rows)."""
    return df.orderBy(*order).limit(n) if n > 0 else df


GRID_STEP = 65536


def fixed_width_histogram(df: DataFrame, col: str, width: float, origin: float | None = None,
                          stop: float | None = None, zero_fill: bool = True, places: int = 6,
                          stop_pad: float = 1.0) -> DataFrame:
    """Bins of ``width`` from ``origin`` (default: the column minimum).

    Edges are ``origin, origin+w, …`` below ``stop`` (default
    ``max + stop_pad·width``, as ``arange(lo, max + w, w)``; ages use
    ``stop_pad=2``, as ``arange(min, max + 2)``); bins are
    left-closed, the last one also right-closed, values outside are not
    counted. ``pct`` is over counted values. With ``zero_fill`` empty bins
    appear with count 0 (the edge list is generated from the bin count).

    The bounds are one scalar subquery carried as a column; the total is an
    aggregate of the counted rows, so nothing meets in one task.
    """
    x = F.col(col).cast("double")
    w = F.lit(float(width))
    lo = F.lit(float(origin)) if origin is not None else F.min(x)
    hi = F.lit(float(stop)) if stop is not None else F.max(x) + F.lit(float(width) * stop_pad)
    bounds_df = df.agg(lo.alias("lo"), hi.alias("hi")).select(
        "lo", (F.ceil((F.col("hi") - F.col("lo")) / w) - 1).cast("bigint").alias("nb")
    )
    tagged = df.select(x.alias("__x"), scalar_row(bounds_df).alias("__b")).where(F.col("__x").isNotNull())
    blo, bnb = F.col("__b.lo"), F.col("__b.nb")
    binned = tagged.where((F.col("__x") >= blo) & (F.col("__x") <= blo + bnb * w)).select(
        F.least(F.floor((F.col("__x") - blo) / w).cast("bigint"), bnb - 1).alias("bin"), blo.alias("lo")
    )
    counts = binned.groupBy("bin", "lo").agg(F.count(F.lit(1)).alias("count"))
    if zero_fill:
        # in two steps, so that no single array holds the whole grid
        runs = bounds_df.select("lo", "nb", F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1, F.lit(GRID_STEP).cast("bigint"))).alias("at"))
        grid = runs.select("lo", F.explode(F.sequence("at", F.least(F.col("at") + GRID_STEP, "nb") - 1)).alias("bin"))
        counts = grid.join(counts.drop("lo"), "bin", "left").select(
            "bin", "lo", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    all_counted = scalar_row(binned.agg(F.count(F.lit(1)).alias("n")))
    total = F.col("__t.n")
    return counts.select("*", all_counted.alias("__t")).select(
        "bin",
        F.round(F.col("lo") + F.col("bin") * w, places).alias("bin_start"),
        F.round(F.col("lo") + (F.col("bin") + 1) * w, places).alias("bin_end"),
        "count",
        F.round(F.when(total > 0, F.col("count") * 100.0 / total), places).alias("pct"),
    )


def equal_bins_histogram(df: DataFrame, col: str, bins: int = 40, places: int = 6) -> DataFrame:
    """``bins`` equal-width bins between the column's min and max (max falls in the last)."""
    x = F.col(col).cast("double")
    mm = scalar_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    tagged = df.select(x.alias("__x"), mm.alias("__m")).where(F.col("__x").isNotNull())
    lo, span = F.col("__m.lo"), F.col("__m.hi") - F.col("__m.lo")
    raw = F.when(span > 0, F.floor((F.col("__x") - lo) / span * F.lit(bins))).otherwise(F.lit(0))
    binned = tagged.select(F.least(raw.cast("bigint"), F.lit(bins - 1).cast("bigint")).alias("bin"),
                           lo.alias("lo"), span.alias("span"))
    return binned.groupBy("bin", "lo", "span").agg(F.count(F.lit(1)).alias("count")).select(
        "bin", F.round(F.col("lo") + F.col("bin") * F.col("span") / F.lit(bins), places).alias("bin_start"), "count"
    )


def monthly_counts(df: DataFrame, col: str, label: str = "end") -> DataFrame:
    """Rows per calendar month of a date column, empty months as 0.

    ``label='end'`` names a month by its last day (pandas ``ME``),
    ``'start'`` by its first day (``MS``). NULL dates are not counted.
    """
    d = F.to_date(F.col(col))
    counts = df.select(F.trunc(d, "month").alias("month")).where(F.col("month").isNotNull()) \
        .groupBy("month").agg(F.count(F.lit(1)).alias("count"))
    span = counts.agg(F.min("month").alias("__a"), F.max("month").alias("__b"))
    months = span.select(F.explode(F.sequence("__a", "__b", F.expr("interval 1 month"))).alias("month"))
    full = months.join(counts, "month", "left").select("month", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    name = F.last_day("month") if label == "end" else F.col("month")
    return full.select(name.alias("month"), "count")


def category_count_median(df: DataFrame, cat: str, value: str, id_col: str, exact: bool = True) -> DataFrame:
    """Per category, count of ids and median value (sort by count desc at read time)."""
    counts = df.groupBy(cat).agg(F.count(F.col(id_col)).alias("quantidade"))
    if exact:
        med = rank_quantiles(df, value, [0.5], ["valor_mediano"], by=[cat])
    else:
        med = df.groupBy(cat).agg(F.percentile_approx(F.col(value).cast("double"), 0.5, 100000).alias("valor_mediano"))
    return counts.join(med, cat, "left")


def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), whisker: float = 1.5, places: int = 6) -> DataFrame:
    """Quartiles, whisker ends (most extreme values inside q1−1.5·IQR, q3+1.5·IQR) and outlier count.

    Quartiles per group are joined back to the rows (one row per group,
    broadcast by AQE when small) and a second aggregation finds the fences.
    """
    x = F.col(value).cast("double")
    keys = list(by)
    base = df.select(*keys, x.alias("__x")).where(F.col("__x").isNotNull())
    q = rank_quantiles(base, "__x", [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=keys)
    if keys:
        from lendwise.operators.joins import broadcast_if_small

        j = base.join(broadcast_if_small(q), keys, "inner")
    else:
        j = base.select("__x", scalar_row(q).alias("__q")).select(
            "__x", F.col("__q.q1").alias("q1"), F.col("__q.median").alias("median"), F.col("__q.q3").alias("q3"))
    lo = F.col("q1") - F.lit(whisker) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(whisker) * (F.col("q3") - F.col("q1"))
    inside = (F.col("__x") >= lo) & (F.col("__x") <= hi)
    out = j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.select(*keys, *[F.round(c, places).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high", "n_outliers", "n")


def lateness_summary(df: DataFrame, col: str = "atraso", places: int = 6) -> DataFrame:
    """Total, on time (≤ 0), late (> 0), late %, mean and median of days late."""
    x = F.col(col)
    med = rank_quantiles(df, col, [0.5], ["m"]).select("m").scalar()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(~(x > 0) | x.isNull(), F.lit(1))).alias("em_dia"),
        F.count(F.when(x > 0, F.lit(1))).alias("atrasados"),
        F.round(F.count(F.when(x > 0, F.lit(1))) * 100.0 / F.count(F.lit(1)), places).alias("taxa_atraso"),
        F.round(F.avg(x.cast("double")), places).alias("media"),
    ).select("*", F.round(med, places).alias("mediana"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column (NULL included once)."""
    return df.select(col).distinct()


def missingness_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count of rows per pattern of NULL indicators ('1' = NULL), in column order."""
    cols = list(cols or df.columns)
    pattern = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def kde_grid(df: DataFrame, col: str, grid_size: int = 200, cut: float = 0.0, places: int = 6,
             prebin: int | None = None) -> DataFrame:
    """Gaussian kernel density on a regular grid, Scott bandwidth ``std · n^(-1/5)``.

    Rows are first reduced to (distinct value, count) — exact, since the
    density is a sum over values — then each distinct value contributes to
    the ``grid_size`` grid points through ``posexplode``; the work is
    distinct-values × grid, independent of the row count. For a continuous
    column with very many distinct values pass ``prebin`` (e.g. 4096): values
    snap to the centres of that many equal bins first (approximate, bounded
    work: prebin × grid).
    """
    x = F.col(col).cast("double")
    if prebin:
        mm = scalar_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
        w = (mm["hi"] - mm["lo"]) / F.lit(prebin)
        idx = F.least(F.floor((x - mm["lo"]) / w), F.lit(prebin - 1))
        x = F.when(w > 0, mm["lo"] + (idx + F.lit(0.5)) * w).otherwise(x)
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    raw = F.col(col).cast("double")
    st = scalar_row(
        df.agg(F.count(raw).alias("n"), F.stddev_samp(raw).alias("sd"), F.min(raw).alias("lo"), F.max(raw).alias("hi"))
        .select("n", "lo", "hi", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
        .select("n", "h", (F.col("lo") - F.lit(cut) * F.col("h")).alias("g0"),
                ((F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("h")) / F.lit(grid_size - 1)).alias("step"))
    )
    j = vals.select("v", "w", st.alias("__st"), F.posexplode(F.array_repeat(F.lit(0), grid_size)).alias("i", "__z"))
    g = F.col("__st.g0") + F.col("i") * F.col("__st.step")
    u = (g - F.col("v")) / F.col("__st.h")
    contrib = F.col("w") * F.exp(F.lit(-0.5) * u * u)
    dens = j.groupBy("i", "__st").agg(F.sum(contrib).alias("s"))
    norm = F.col("__st.n") * F.col("__st.h") * F.lit((2 * 3.141592653589793) ** 0.5)
    return dens.select(F.col("i").alias("grid_index"), F.round(g, places).alias("x"),
                       F.round(F.col("s") / norm, 12).alias("density"))
