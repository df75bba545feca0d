"""Global order-dependent values and exact quantiles without a single-partition window (W3, M14, A10, A16–A18 helpers).

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task. Instead the rows are cut into ranges of the full ordering (ties broken
by a unique column, so even a hot timestamp is split), each range computes
local prefix sums, and a table of range totals — one row per range, a number
set by the caller or the session, not the data — supplies the offsets.

The cuts are literals in the plan, taken from a bounded sample that one job
draws while the plan is built (the rows of smallest hash, so the sample is
the same on every run). Both passes over the rows therefore agree on the
range of each row, also when a stage runs again after an executor was lost,
and nothing has to be written in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 32


def _plain(df: DataFrame, name: str) -> Column:
    """An order column as a type whose values survive the way to the driver and back exactly, in the same order."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if kind == "date":
        return F.unix_date(c)
    if kind in ("boolean", "float"):
        return c.cast("double")
    return c


def range_ids(df: DataFrame, order: Sequence[str], ranges: int) -> Column:
    """The number of the range (0 … ranges − 1) that a row falls into, in ``order`` ascending with NULLs first.

    The cuts are quantiles of a sample of at most ``ranges × 32`` rows, found
    by one job now; a row's range is then found by bisection over the literal
    cuts. Rows that are equal in all of ``order`` share a range.
    """
    keys = [_plain(df, c).alias(f"k{i}") for i, c in enumerate(order)]
    row = F.struct(*keys)
    if ranges < 2:
        return F.lit(0)
    sample = df.select(row.alias("row"), F.xxhash64(row).alias("h")).orderBy("h").limit(ranges * SAMPLE_PER_RANGE)
    kind = df.select(row.alias("row")).schema["row"].dataType.simpleString()
    drawn = sample.select(F.array_sort(F.collect_list("row")).alias("rows")).first()["rows"]
    cuts = sorted({len(drawn) * i // ranges for i in range(1, ranges)} - {0})
    cuts = [drawn[i] for i in cuts if i < len(drawn)]
    if not cuts:
        return F.lit(0)
    literal = F.array(*[F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(cut)]).cast(kind) for cut in cuts])
    step = 1 << (len(cuts).bit_length() - 1)
    found: Column = F.lit(0)
    halves = []
    while step:
        halves.append(step)
        step //= 2
    # the largest n with cuts[n - 1] <= row, halving the step each time
    found = F.aggregate(
        F.array(*[F.lit(h) for h in halves]), F.lit(0),
        lambda n, h: F.when((n + h <= len(cuts)) & (F.get(literal, n + h - 1) <= row), n + h).otherwise(n),
    )
    return found


def prefix_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], partitions: int | None = None,
                inclusive: bool = True, suffix: str = "_cum") -> DataFrame:
    """Add ``{v}{suffix}``: running sum of each value column in the global ``order``.

    ``order`` must be a total order (end in a unique column) for a
    deterministic result, and ``df`` must give the same rows each time it is
    computed: it is read for the sample, for the range totals and for the
    local sums. ``inclusive=False`` gives the sum of strictly earlier rows.
    ``partitions`` is the number of ranges (default: the session's
    ``spark.sql.shuffle.partitions``).
    """
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__pid", range_ids(df, order, ranges))
    totals = ranged.groupBy("__pid").agg(*[F.sum(F.col(v)).alias(f"__t_{v}") for v in values])
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row per range
        "__pid", *[F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}") for v in values]
    )
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w_loc = Window.partitionBy("__pid").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(*frame)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(F.col(v)).over(w_loc), F.lit(0)).alias(f"__l_{v}") for v in values]
    )
    out = local.join(F.broadcast(offsets), "__pid")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__o_{v}") + F.col(f"__l_{v}")).alias(f"{v}{suffix}") for v in values],
    )


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number in the global ``order`` (distributed)."""
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    numbered = prefix_sums(ones, order, ["__one"], partitions, inclusive=True, suffix="_rn")
    return numbered.drop("__one").withColumnRenamed("__one_rn", out)


def chunk_numbers(df: DataFrame, order: Sequence[str], chunk_size: int = 500, out: str = "chunk",
                  partitions: int | None = None) -> DataFrame:
    """0-based chunk of ``chunk_size`` consecutive rows in the global ``order``."""
    numbered = global_row_number(df, order, "__rn", partitions)
    return numbered.withColumn(out, F.floor((F.col("__rn") - 1) / F.lit(chunk_size)).cast("bigint")).drop("__rn")


# Ranks that a sketch may be wrong by are 1 / this of a group's rows.
SKETCH_ACCURACY = 20_000


def rank_quantiles(df: DataFrame, value: str, qs: Sequence[float], names: Sequence[str] | None = None,
                   by: Sequence[str] = (), partitions: int | None = None, accuracy: int = SKETCH_ACCURACY,
                   few_groups: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles (pandas / ``quantile_cont``) by bracket and refine.

    Quantile ``q`` of a group of ``n`` values lies between the values of
    ranks ``floor((n−1)·q)`` and the next. A first pass sketches each group
    (``percentile_approx``: bounded memory, merged map-side) for a bracket of
    values that must hold both, ten sketch errors wide. A second pass counts
    the values below each bracket and, per distinct value, those inside: one
    part in ``accuracy / 10`` of the rows, or all of a group of fewer than
    ``4 · accuracy`` rows. Only these are ranked. Nothing is written, and no
    task ever ranks more than a bracket. One row per group, columns ``names``
    (default ``q0``, ``q1``…); NULLs are ignored and groups without a value
    are left out. A bracket that missed its ranks would raise an error.

    ``few_groups`` says that the number of groups is bounded (such as column
    names): their brackets are broadcast. Otherwise brackets of many groups
    are sketched once, now, and broadcast only below a measured size.
    ``partitions`` spreads the rows over so many tasks first (default: as they come).
    """
    keys = list(by)
    names = list(names or [f"q{i}" for i in range(len(qs))])
    base = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    base = base.repartition(partitions) if partitions else base
    margin = 5.0 / accuracy
    ends = [min(1.0, max(0.0, q + side)) for q in qs for side in (-margin, margin)]
    whole = F.col("__n") <= 4 * accuracy
    brackets = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ends, accuracy).alias("__e")
    ).where("__n > 0").select(*keys, "__n", F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(~whole, F.col("__e")[2 * i]).alias("lo"), F.when(~whole, F.col("__e")[2 * i + 1]).alias("hi"))
        for i in range(len(qs))
    ]).alias("__b"))
    if not keys:
        fit = brackets.select(F.struct("__n", "__b").alias("s")).scalar()
        tagged = base.select("__v", fit.alias("__s")).select("__v", F.col("__s.__n").alias("__n"), F.col("__s.__b").alias("__b"))
    else:
        from lendwise.operators.joins import broadcast_if_small

        right = brackets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", "__b")
        right = F.broadcast(right) if few_groups else broadcast_if_small(right)
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        tagged = base.join(right, on, "inner").select(*keys, "__v", "__n", "__b")
    # each value once per bracket that it is inside of or above; all values below a bracket count as one
    seen = tagged.select(*keys, "__n", "__v", F.inline("__b")).where(F.col("hi").isNull() | (F.col("__v") <= F.col("hi")))
    below = F.coalesce(F.col("__v") < F.col("lo"), F.lit(False))
    counted = seen.select(*keys, "__n", "i", below.alias("__below"), F.when(~below, F.col("__v")).alias("__v")) \
        .groupBy(*keys, "__n", "i", "__below", "__v").agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys, "__n", "i").orderBy(F.col("__below").desc(), "__v")
    ranked = counted.select("*", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__end"))
    start = F.col("__end") - F.col("__c")             # ranks [start, end) hold this value
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("__n") - 1).cast("double") * F.lit(float(q))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            held = (F.col("i") == i) & ~F.col("__below") & (start <= rank) & (rank < F.col("__end"))
            aggs.append(F.max(F.when(held, F.col("__v"))).alias(f"__{side}{i}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__f{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    cells = []
    for i in range(len(qs)):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        missed = (lo.isNull() | hi.isNull()) & F.col(f"__f{i}").isNotNull()
        sure = F.when(missed, F.raise_error(F.lit("a quantile's bracket misses its ranks: raise accuracy")).cast("double"))
        between = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"__f{i}"))  # equal ends may be infinite
        cells.append(F.coalesce(sure, between).alias(names[i]))
    if not keys:  # an aggregate without groups has a row even where there are no values
        return out.select(*cells)
    return out.select(*keys, *cells)
