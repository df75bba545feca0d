"""Drift between a reference and an analysis frame.

Univariate drift (D3) is the Jensen-Shannon distance (base 2) between the
reference distribution of a feature and its distribution in each analysis
chunk. Numeric features are binned on equal-width bins of the reference
range (values outside clamp to the end bins); text features use their
categories. Only (feature, chunk, bin) cells present in the analysis are
materialised: reference bins absent from a chunk add ``p/2`` each, which sums
to ``(1 − Σ p over present bins)/2`` — no chunk × bin grid is built.

Multivariate drift (D2) is the mean PCA reconstruction error of numbers and
categories per chunk, with a band of reference mean ± 3 standard deviations
of reference chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lendwise.operators.ordering import chunk_numbers

# The drift calculators' defaults.
CHUNK_SIZE = 500
JS_ALERT_THRESHOLD = 0.1
DRIFT_ALERT_RATE = 0.7
BAND_SIGMAS = 3.0


def _long_features(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")).alias("cat"),
        )
        for c in features
    ])
    return df.select(*extra, F.inline(cells))


def _bin_expr(bins: int) -> F.Column:
    span = F.col("hi") - F.col("lo")
    idx = F.when(span > 0, F.floor((F.col("num") - F.col("lo")) / span * F.lit(bins))).otherwise(F.lit(0))
    clamped = F.greatest(F.lit(0), F.least(idx.cast("bigint"), F.lit(bins - 1).cast("bigint")))
    return F.when(F.col("cat").isNotNull(), F.col("cat")) \
        .when(F.col("num").isNotNull(), clamped.cast("string")) \
        .otherwise(F.lit("__null__"))


def univariate_drift(reference: DataFrame, analysis: DataFrame, features: Sequence[str], order: Sequence[str],
                     chunk_size: int = CHUNK_SIZE, bins: int = 10, threshold: float = JS_ALERT_THRESHOLD,
                     places: int = 9) -> DataFrame:
    """D3: one row per (feature, chunk): Jensen-Shannon distance and alert flag.

    ``order`` (ending in a unique column) defines the analysis chunks (W3).
    NULLs form their own bin.
    """
    from lendwise.operators.joins import broadcast_if_small

    ref = _long_features(reference, features)
    # one row per feature: bounded by the (schema-sized) feature list
    rng = F.broadcast(ref.groupBy("feature").agg(F.min("num").alias("lo"), F.max("num").alias("hi")))
    ref_b = ref.join(rng, "feature").select("feature", _bin_expr(bins).alias("bin"))
    ref_n = ref_b.groupBy("feature").agg(F.count(F.lit(1)).alias("rn"))
    p = ref_b.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c")).join(ref_n, "feature") \
        .select("feature", "bin", (F.col("c") / F.col("rn")).alias("p"))

    # only the ordering and feature columns are numbered (and checkpointed)
    cols = list(dict.fromkeys([*order, *features]))
    chunked = chunk_numbers(analysis.select(*cols), order, chunk_size)
    ana = _long_features(chunked, features, extra=["chunk"]).join(rng, "feature") \
        .select("feature", "chunk", _bin_expr(bins).alias("bin"))
    q_counts = ana.groupBy("feature", "chunk", "bin").agg(F.count(F.lit(1)).alias("c"))
    q = q_counts.withColumn("q", F.col("c") / F.sum("c").over(Window.partitionBy("feature", "chunk")))
    j = q.join(broadcast_if_small(p), ["feature", "bin"], "left").select("feature", "chunk", "q", F.coalesce("p", F.lit(0.0)).alias("p"))
    m = (F.col("p") + F.col("q")) / 2.0
    term = F.when(F.col("p") > 0, 0.5 * F.col("p") * F.log2(F.col("p") / m)).otherwise(F.lit(0.0)) + \
        F.when(F.col("q") > 0, 0.5 * F.col("q") * F.log2(F.col("q") / m)).otherwise(F.lit(0.0))
    per = j.groupBy("feature", "chunk").agg(F.sum(term).alias("__s"), F.sum("p").alias("__pp"))
    jsd = F.greatest(F.col("__s") + 0.5 * (F.lit(1.0) - F.col("__pp")), F.lit(0.0))
    dist = F.round(F.sqrt(jsd), places)
    return per.select("feature", "chunk", dist.alias("js_distance"), (dist > threshold).alias("alert"))


def alert_summary(drift: DataFrame, alert: str = "alert", rate_threshold: float = DRIFT_ALERT_RATE) -> DataFrame:
    """Alert count, alert rate (NULL alert = false) and ``drift_detected = rate ≥ threshold``."""
    a = F.coalesce(F.col(alert), F.lit(False)).cast("int")
    row = drift.agg(F.sum(a).cast("bigint").alias("n_alerts"), F.avg(a.cast("double")).alias("alert_rate"))
    rate = F.coalesce(F.col("alert_rate"), F.lit(0.0))
    return row.select(F.coalesce("n_alerts", F.lit(0).cast("bigint")).alias("n_alerts"), rate.alias("alert_rate"),
                      (rate >= rate_threshold).alias("drift_detected"))


def mixed_projection(reference: DataFrame, features: Sequence[str], variance: float = 0.65):
    """D2 fit: mixed-type features as one scaled vector, and the leading components of the reference.

    Text features become the share that their category has in the reference
    (:func:`~lendwise.operators.encoders.frequency_dictionary`), numbers are
    median-imputed; both are standardised, so a rare category lies as far out
    as a rare amount. PCA keeps the fewest components that explain
    ``variance``. Returns ``errors(df)``, which adds a row's distance between
    its scaled vector and its projection as ``error``. All that is fitted —
    medians, shares, means, loadings — comes from the reference alone.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from lendwise.operators.encoders import frequency_dictionary, frequency_encode
    from lendwise.operators.joins import broadcast_if_small

    numeric = {f.name for f in reference.schema.fields if isinstance(f.dataType, NumericType)}
    numbers = [c for c in features if c in numeric]
    texts = [c for c in features if c not in numeric]
    shares = broadcast_if_small(frequency_dictionary(reference, texts)) if texts else None

    def numbered(df: DataFrame) -> DataFrame:
        typed = df.withColumns({f"__n_{c}": F.col(c).cast("double") for c in numbers})
        return frequency_encode(typed, texts, shares, "__f_") if texts else typed

    inputs = [f"__i_{c}" for c in numbers] + [f"__f_{c}" for c in texts]
    stages = [Imputer(inputCols=[f"__n_{c}" for c in numbers], outputCols=[f"__i_{c}" for c in numbers], strategy="median")] \
        if numbers else []
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="__v", handleInvalid="keep"),
        StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True),
    ]
    ready = numbered(reference)
    prep = Pipeline(stages=stages).fit(ready)
    full = PCA(k=len(inputs), inputCol="__z", outputCol="__pc").fit(prep.transform(ready))
    k, explained = 0, 0.0
    for share in full.explainedVariance.toArray():
        k, explained = k + 1, explained + share
        if explained >= variance:
            break
    loadings = full.pc.toArray()[:, :k]  # features × k: model metadata, not data

    def errors(df: DataFrame) -> DataFrame:
        z = prep.transform(numbered(df)).withColumn("__za", vector_to_array(F.col("__z")))
        at = [F.col("__za")[i] for i in range(len(inputs))]
        parts = [sum(at[i] * float(loadings[i, j]) for i in range(len(inputs))) for j in range(k)]
        left = [at[i] - sum(parts[j] * float(loadings[i, j]) for j in range(k)) for i in range(len(inputs))]
        return z.select(*df.columns, F.sqrt(sum(x * x for x in left)).alias("error"))

    return errors


def reconstruction_drift(reference: DataFrame, analysis: DataFrame, features: Sequence[str], order: Sequence[str],
                         chunk_size: int = CHUNK_SIZE, variance: float = 0.65, sigmas: float = BAND_SIGMAS,
                         ref_order: Sequence[str] | None = None) -> DataFrame:
    """PCA reconstruction error of numeric and text features per analysis chunk, with a reference band.

    Rows are projected as :func:`mixed_projection` describes. Alert when a
    chunk's mean error leaves ``ref_mean ± sigmas · sd(reference chunk means)``.
    """
    errors = mixed_projection(reference, features, variance)
    first = list(ref_order or order)
    ref_chunks = chunk_numbers(errors(reference.select(*dict.fromkeys([*first, *features]))), first, chunk_size) \
        .groupBy("chunk").agg(F.avg("error").alias("e"))
    band = ref_chunks.agg(F.avg("e").alias("m"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("sd"))
    limits = band.select(F.struct((F.col("m") - sigmas * F.col("sd")).alias("lo"), (F.col("m") + sigmas * F.col("sd")).alias("hi"))
                         .alias("b")).scalar()
    ana = chunk_numbers(errors(analysis.select(*dict.fromkeys([*order, *features]))), list(order), chunk_size) \
        .groupBy("chunk").agg(F.avg("error").alias("reconstruction_error"), F.count(F.lit(1)).alias("n"))
    error = F.col("reconstruction_error")
    return ana.select("chunk", error, "n", limits.alias("__b")).select(
        "chunk", error, "n", F.col("__b.lo").alias("lower_threshold"), F.col("__b.hi").alias("upper_threshold"),
        ((error < F.col("__b.lo")) | (error > F.col("__b.hi"))).alias("alert"))
