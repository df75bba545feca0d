"""Fit/apply encoders and imputers as DataFrame joins.

A fitted encoder is itself a small DataFrame (one row per column × category,
or one row of medians); applying it is a join that Catalyst/AQE turns into a
broadcast only when the measured size is under the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "Missing"


def quantile_row(df: DataFrame, cols: Sequence[str], q: float = 0.5, exact: bool = True,
                 accuracy: int = 100000, suffix: str = "") -> DataFrame:
    """One-row table of the ``q`` quantile of each column (nulls ignored).

    ``exact`` gives the linear-interpolated quantile (pandas / DuckDB
    ``quantile_cont``) by bracket and refine
    (:func:`lendwise.operators.ordering.rank_quantiles`), so no task ever
    holds all distinct values of a column; ``exact=False`` uses
    ``percentile_approx`` (one pass, bounded memory, approximate).
    """
    if not exact:
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), q, accuracy).alias(f"{c}{suffix}") for c in cols])
    from lendwise.operators.ordering import rank_quantiles

    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])))
    per_col = rank_quantiles(long, "value", [q], ["q"], by=["column"], few_groups=True)
    return per_col.groupBy().pivot("column", list(cols)).agg(F.first("q")).select(
        *[F.col(c).alias(f"{c}{suffix}") for c in cols])


def scalar_row(one_row: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery.

    Catalyst runs the subquery once and inlines its value; no join is
    planned, and a filter on it can even reach the parquet scan.
    """
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()


def fill_with_quantile(df: DataFrame, cols: Sequence[str], q: float = 0.5, fitted: DataFrame | None = None,
                       exact: bool = True) -> DataFrame:
    """Replace NULLs by the column median (fit on ``fitted`` if given, else on ``df``).

    The statistics are one row, read back as a scalar subquery.
    """
    stats = scalar_row(quantile_row(fitted if fitted is not None else df, cols, q, exact=exact))
    out = [F.coalesce(F.col(c).cast("double"), stats[c]).alias(c) if c in cols else F.col(c) for c in df.columns]
    return df.select(*out)


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M5 fit: most frequent non-null value of each column; ties → smallest value.

    One ``unpivot`` and one aggregation for all columns (counts combine map-side);
    the ranking then runs over the distinct (column, value) pairs only.
    """
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("kv")
    ).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return best


def fill_with_mode(df: DataFrame, cols: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """M5 apply: NULL → the fitted mode of the column (as text)."""
    modes = mode_table(fitted if fitted is not None else df, cols)
    wide = modes.groupBy().pivot("column", list(cols)).agg(F.first("mode"))
    m = scalar_row(wide)
    return df.select(*[F.coalesce(F.col(c).cast("string"), m[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


def ordinal_dictionary(df: DataFrame, cols: Sequence[str], missing: str = MISSING) -> DataFrame:
    """M7 fit: (column, category, code) with codes 0..k-1 in sorted category order.

    NULL becomes the category ``missing``. Codes are ranks of the distinct
    (column, category) pairs from the distributed prefix sum, so even a
    column with very many categories is never ranked inside one task.
    """
    from lendwise.operators.ordering import prefix_sums

    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("category"))
        for c in cols]))).distinct().withColumn("__one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(pairs, ["column", "category"], ["__one"], inclusive=False, suffix="_before")
    first = ranked.groupBy("column").agg(F.min("__one_before").alias("__base"))
    from lendwise.operators.joins import broadcast_if_small

    out = ranked.join(broadcast_if_small(first, materialize=False), "column")
    return out.select("column", "category", (F.col("__one_before") - F.col("__base")).cast("double").alias("code"))


def ordinal_encode(df: DataFrame, cols: Sequence[str], dictionary: DataFrame, prefix: str = "feat_",
                   suffix: str = "_enc", unknown: float = -1.0, missing: str = MISSING) -> DataFrame:
    """M7 apply: add ``{prefix}{c}{suffix}`` codes; unseen categories → ``unknown``.

    The dictionary (one row per category) is broadcast after a size check,
    so all columns are encoded in one stage without shuffling ``df``.
    """
    from lendwise.operators.joins import broadcast_if_small

    dictionary = broadcast_if_small(dictionary)
    out = df
    for c in cols:
        d = dictionary.where(F.col("column") == c).select(
            F.col("category").alias(f"__cat_{c}"), F.col("code").alias(f"{prefix}{c}{suffix}")
        )
        key = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        out = out.join(d, key == F.col(f"__cat_{c}"), "left").drop(f"__cat_{c}")
        out = out.withColumn(f"{prefix}{c}{suffix}", F.coalesce(F.col(f"{prefix}{c}{suffix}"), F.lit(unknown)))
    return out


def frequency_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fit of a frequency encoding: (column, category, share), the share of each category among the column's non-null rows.

    A further row per column with a NULL category holds the share of its most
    frequent category, which stands for missing values (as if they were
    filled with the mode before). One unpivot and one aggregation, combined
    map-side; no label is looked at.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols]))).where("category IS NOT NULL")
    counts = long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))
    # one row per column name: bounded by the argument
    totals = F.broadcast(counts.groupBy("column").agg(F.sum("n").alias("all"), F.max("n").alias("most")))
    known = counts.join(totals, "column").select("column", "category", (F.col("n") / F.col("all")).alias("share"))
    missing = totals.select("column", F.lit(None).cast("string").alias("category"), (F.col("most") / F.col("all")).alias("share"))
    return known.unionByName(missing)


def frequency_encode(df: DataFrame, cols: Sequence[str], dictionary: DataFrame, prefix: str = "freq_") -> DataFrame:
    """Add ``{prefix}{c}``: the fitted share of the row's category, 0 for one never seen, the mode's share for NULL.

    The dictionary is broadcast only below a measured size; beyond it Catalyst plans shuffle joins.
    """
    from lendwise.operators.joins import broadcast_if_small

    dictionary = broadcast_if_small(dictionary)
    out = df
    for c in cols:
        d = dictionary.where(F.col("column") == c).select(F.col("category").alias(f"__cat_{c}"), F.col("share").alias(f"{prefix}{c}"))
        out = out.join(d, F.col(c).cast("string").eqNullSafe(F.col(f"__cat_{c}")), "left").drop(f"__cat_{c}")
        out = out.withColumn(f"{prefix}{c}", F.coalesce(F.col(f"{prefix}{c}"), F.lit(0.0)))
    return out


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """M6: one 0/1 column per named category, ``{column}_{category}``; any other value → all zeros.

    The categories name output columns, so the caller states them; an encoding
    fitted from data belongs in the vector pipeline (``StringIndexer`` +
    ``OneHotEncoder`` in :mod:`lendwise.plans.train`).
    """
    exprs = [F.col(c) for c in df.columns]
    for column, names in categories.items():
        src = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
        exprs += [(src == F.lit(name)).cast("int").alias(f"{column}_{name}") for name in names]
    return df.select(*exprs)


def hash_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42, out: str = "is_train") -> DataFrame:
    """M8: stateless split: first 8 hex digits of md5(key ':' seed) below fraction · 2³².

    No shuffle, reproducible on any cluster size, stratified in expectation.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, h < F.lit(int(fraction * (1 << 32))))


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = 0.8, seed: int = 42,
                     out: str = "is_train") -> DataFrame:
    """M8 option: exact per-class counts — ``round(n_class · fraction)`` rows of each class train.

    Rows are ordered inside their class by the seeded md5 of the key (a
    reproducible shuffle) and numbered with the distributed prefix sum, so
    no class is ever numbered inside one task.
    """
    from lendwise.operators.joins import broadcast_if_small
    from lendwise.operators.ordering import prefix_sums

    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    tagged = df.withColumn("__h", h).withColumn("__one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(tagged, [label, "__h", key], ["__one"], inclusive=True, suffix="_rank")
    sizes = ranked.groupBy(label).agg(F.min(F.col("__one_rank") - 1).alias("__base"), F.count(F.lit(1)).alias("__n"))
    j = ranked.join(broadcast_if_small(sizes, materialize=False), label)
    cut = F.round(F.col("__n") * F.lit(float(fraction)))
    return j.select(*df.columns, ((F.col("__one_rank") - F.col("__base")) <= cut).alias(out))
