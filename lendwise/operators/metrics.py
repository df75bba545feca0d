"""Classification metrics as aggregations.

Exact ROC AUC: scores are first grouped (positives and negatives per
distinct score, combined map-side), then the number of negatives strictly
below each score comes from the distributed prefix sum in
:mod:`lendwise.operators.ordering`. Ties count one half, as the rank-based
(Mann-Whitney) definition does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.operators.ordering import prefix_sums


def auc_table(df: DataFrame, label: str, score: str, by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact ROC AUC per group (one row per group, NULL AUC when a class is missing).

    Rows with a NULL label or score are ignored.
    """
    keys = list(by)
    base = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    g = base.groupBy(*keys, F.col(score).cast("double").alias("__s")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("__p"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("__n"),
    )
    cum = prefix_sums(g, [*keys, "__s"], ["__n"], partitions, inclusive=False, suffix="_below")
    # within a group, negatives below = running count minus the group's own offset
    w = cum.groupBy(*keys).agg(
        F.min(F.col("__n_below")).alias("__base"),
    )
    # without groups the running count starts at 0: no base to subtract. With
    # groups the one-row-per-group offsets are broadcast after a size check.
    if keys:
        from lendwise.operators.joins import broadcast_if_small

        j = cum.join(broadcast_if_small(w, materialize=False), keys, "inner")
    else:
        j = cum.withColumn("__base", F.lit(0).cast("bigint"))
    below = F.col("__n_below") - F.col("__base")
    agg = j.groupBy(*keys).agg(
        F.sum(F.col("__p") * (below + F.col("__n") / F.lit(2.0))).alias("__num"),
        F.sum("__p").alias("n_pos"),
        F.sum("__n").alias("n_neg"),
    )
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("__num") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
    return agg.select(*keys, auc.alias("auc"), "n_pos", "n_neg")


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class_prf(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class; zero division → 0.

    Classes are the union of true and predicted labels. One pass: each row
    contributes to its true class and its predicted class.
    """
    y, p = F.col(label), F.col(pred)
    contrib = F.array(
        F.struct(y.alias("cls"), F.lit(1).alias("actual"), F.lit(0).alias("predicted"), (y == p).cast("int").alias("tp")),
        F.struct(p.alias("cls"), F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.lit(0).alias("tp")),
    )
    long = df.where(y.isNotNull() & p.isNotNull()).select(F.inline(contrib))
    c = long.groupBy("cls").agg(
        F.sum("tp").cast("bigint").alias("tp"),
        F.sum("predicted").cast("bigint").alias("n_pred"),
        F.sum("actual").cast("bigint").alias("support"),
    )
    prec = _safe_div(F.col("tp"), F.col("n_pred"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    return c.select(
        F.col("cls").alias("class"),
        prec.alias("precision"),
        rec.alias("recall"),
        _safe_div(F.lit(2.0) * prec * rec, prec + rec).alias("f1"),
        "support",
    )


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float = 0.3, strict: bool = True) -> DataFrame:
    """Binary confusion counts at ``score > threshold`` (``strict=False``: ``>=``), zero-filled."""
    s, y = F.col(score), F.col(label)
    yhat = (s > threshold) if strict else (s >= threshold)
    base = df.where(y.isNotNull() & s.isNotNull()).select(y.cast("int").alias("y"), yhat.cast("int").alias("p"))
    row = base.agg(*[
        F.count(F.when((F.col("y") == a) & (F.col("p") == b), F.lit(1))).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)
    ])
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("count"))
        for a in (0, 1) for b in (0, 1)
    ])
    return row.select(F.inline(cells))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float] = (0.3, 0.5, 0.9)) -> DataFrame:
    """Per threshold (``score >= t``) and class: precision, recall, F1, support and accuracy.

    The thresholds are a literal array exploded per row (a fixed, small
    factor), then one aggregation per threshold.
    """
    s, y = F.col(score), F.col(label).cast("int")
    base = df.where(F.col(label).isNotNull() & s.isNotNull()).select(
        y.alias("y"), s.alias("s"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    )
    p = (F.col("s") >= F.col("threshold")).cast("int")
    c = base.groupBy("threshold").agg(
        *[F.count(F.when((F.col("y") == a) & (p == b), F.lit(1))).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = _safe_div(F.col("c00") + F.col("c11"), total)
    rows = []
    for k, (tp, fp, fn) in {0: ("c00", "c10", "c01"), 1: ("c11", "c01", "c10")}.items():
        prec = _safe_div(F.col(tp), F.col(tp) + F.col(fp))
        rec = _safe_div(F.col(tp), F.col(tp) + F.col(fn))
        rows.append(F.struct(
            F.lit(k).alias("class"), prec.alias("precision"), rec.alias("recall"),
            _safe_div(F.lit(2.0) * prec * rec, prec + rec).alias("f1"),
            (F.col(tp) + F.col(fn)).alias("support"), acc.alias("accuracy"),
        ))
    return c.select("threshold", F.inline(F.array(*rows)))
