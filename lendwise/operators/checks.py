"""Monitoring checks, champion selection and the promotion gate.

Every check is a one-row DataFrame; the final decision joins one-row frames
(no data rows move), and thresholds are arguments with the reference's
defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.operators.metrics import auc_table

# Default thresholds of the monitoring job.
MIN_AUC_DROP = 0.03
DENIED_THRESHOLD = 0.5
DENIED_MIN_RATE = 0.90
MEAN_SCORE_RETRAIN_ABOVE = 0.2
# Default gate settings.
GATE_MAX_REGRESSION = 0.005


def auc_decay(reference: DataFrame, analysis: DataFrame, label: str, score: str,
              min_drop: float = MIN_AUC_DROP) -> DataFrame:
    """Reference AUC − analysis AUC and ``decay_detected = drop ≥ min_drop``.

    Skipped (``decay_checked`` false) when either frame lacks the columns.
    """
    have = all(c in df.columns for df in (reference, analysis) for c in (label, score))
    if not have:
        return reference.sparkSession.range(1).select(
            F.lit(False).alias("decay_checked"), F.lit(None).cast("double").alias("reference_auc"),
            F.lit(None).cast("double").alias("analysis_auc"), F.lit(None).cast("double").alias("auc_drop"),
            F.lit(False).alias("decay_detected"))
    # one grouped AUC over both sides: a single score aggregation and prefix-sum pass
    both = reference.select(F.lit(0).alias("__side"), label, score).unionByName(
        analysis.select(F.lit(1).alias("__side"), label, score))
    aucs = auc_table(both, label, score, by=["__side"]).agg(
        F.max(F.when(F.col("__side") == 0, F.col("auc"))).alias("r"),
        F.max(F.when(F.col("__side") == 1, F.col("auc"))).alias("a"))
    pair = aucs.select(F.struct("r", "a").alias("s")).scalar()
    r, a = pair["r"], pair["a"]
    drop = r - a
    return reference.sparkSession.range(1).select(
        F.lit(True).alias("decay_checked"), r.alias("reference_auc"), a.alias("analysis_auc"), drop.alias("auc_drop"),
        F.coalesce(drop >= min_drop, F.lit(False)).alias("decay_detected"))


def denied_rate(events: DataFrame, prob: str = "probability", threshold: float = DENIED_THRESHOLD,
                denominator_offset: int = 0, min_rate: float = DENIED_MIN_RATE) -> DataFrame:
    """Share of numeric probabilities ``≥ threshold``; retrain when below ``min_rate``.

    The denominator counts parseable probabilities plus ``denominator_offset``
    (the as-coded job uses threshold 0.1 and offset 10). A missing column raises.
    """
    if prob not in events.columns:
        raise RuntimeError(f"prediction events are missing probability column {prob!r}; columns: {events.columns}")
    p = F.col(prob).try_cast("double")
    row = events.agg(F.count_if(p >= threshold).alias("negado_count"),
                     (F.count(p) + F.lit(denominator_offset)).alias("negado_denominator"))
    frac = F.when(F.col("negado_denominator") > 0, F.col("negado_count") / F.col("negado_denominator"))
    return row.select("negado_count", "negado_denominator", frac.alias("negado_fraction"),
                      F.coalesce(frac < min_rate, F.lit(False)).alias("negado_below_threshold_retrain"))


def mean_score(events: DataFrame, prob: str = "probability", retrain_above: float = MEAN_SCORE_RETRAIN_ABOVE) -> DataFrame:
    """Mean parseable probability; retrain when above ``retrain_above``."""
    col = prob if prob in events.columns else "probability"
    m = F.avg(F.col(col).try_cast("double"))
    return events.agg(m.alias("probability_avg")).select(
        "probability_avg", F.coalesce(F.col("probability_avg") > retrain_above, F.lit(False)).alias("probability_above_threshold_retrain"))


def log_checks(events: DataFrame, prob: str = "probability", threshold: float = DENIED_THRESHOLD, denominator_offset: int = 0,
               min_rate: float = DENIED_MIN_RATE, retrain_above: float = MEAN_SCORE_RETRAIN_ABOVE) -> DataFrame:
    """D6 + D7 from one scan of the prediction log: the columns of :func:`denied_rate` and :func:`mean_score`."""
    if prob not in events.columns:
        raise RuntimeError(f"prediction events are missing probability column {prob!r}; columns: {events.columns}")
    p = F.col(prob).try_cast("double")
    row = events.agg(F.count_if(p >= threshold).alias("negado_count"),
                     (F.count(p) + F.lit(denominator_offset)).alias("negado_denominator"), F.avg(p).alias("probability_avg"))
    frac = F.when(F.col("negado_denominator") > 0, F.col("negado_count") / F.col("negado_denominator"))
    return row.select("negado_count", "negado_denominator", frac.alias("negado_fraction"),
                      F.coalesce(frac < min_rate, F.lit(False)).alias("negado_below_threshold_retrain"), "probability_avg",
                      F.coalesce(F.col("probability_avg") > retrain_above, F.lit(False)).alias("probability_above_threshold_retrain"))


def retrain_decision(*checks: DataFrame, flags: tuple[str, ...] = (
        "drift_detected", "decay_detected", "negado_below_threshold_retrain", "probability_above_threshold_retrain")) -> DataFrame:
    """One row combining one-row check frames; ``should_retrain`` = OR of the present flags."""
    out = checks[0]
    for c in checks[1:]:
        out = _zip_one_row(out, c)
    present = [f for f in flags if f in out.columns]
    retrain = F.lit(False)
    for f in present:
        retrain = retrain | F.coalesce(F.col(f), F.lit(False))
    return out.select(retrain.alias("should_retrain"), *out.columns)


def _zip_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Place the single row of ``b`` beside the single row of ``a`` (scalar subqueries)."""
    s = b.select(F.struct(*b.columns).alias("s")).scalar()
    return a.select("*", *[s[c].alias(c) for c in b.columns])


def decision_report(decision: DataFrame) -> DataFrame:
    """The decision row as one JSON object; NULL values are kept as ``null``."""
    return decision.select(F.to_json(F.struct(*decision.columns), {"ignoreNullFields": "false"}).alias("report"))


def champion(runs: DataFrame, model: str = "model", version: str = "version", stage: str = "stage",
             metric: str = "valid_auc") -> DataFrame:
    """Per model, the newest Production version, else the highest version number (numeric order).

    The chosen run's metric may be NULL (missing run metric). A row without a
    version is no registered run; a version that is no integer fails the job,
    since leaving it out could name the wrong champion.
    """
    text = F.col(version).cast("string")
    v = F.when(text.isNotNull(), F.coalesce(text.try_cast("bigint"), F.raise_error(
        F.concat(F.lit("model version is not an integer: "), text)).cast("bigint")))
    is_prod = (F.col(stage) == "Production").cast("int")
    key = F.struct(is_prod.alias("p"), v.alias("v"))
    picked = runs.where(v.isNotNull()).groupBy(model).agg(
        F.max_by(F.struct(v.alias("version"), F.col(stage).alias("stage"), F.col(metric).alias("valid_auc")), key).alias("r"))
    return picked.select(model, F.col("r.version").alias("champion_version"), F.col("r.stage").alias("champion_stage"),
                         F.col("r.valid_auc").alias("champion_auc"))


def promotion_gate(candidates: DataFrame, new_auc: str = "new_auc", champion_auc: str = "champion_auc",
                   min_auc: float | None = None, max_drop: float = GATE_MAX_REGRESSION,
                   disabled: bool = False, require_improvement: bool = False) -> DataFrame:
    """Gate each candidate row, in the reference's order of checks.

    disabled → pass; below ``min_auc`` → fail; no champion → pass; below
    champion − ``max_drop`` → fail; improvement required and not above the
    champion → fail; else pass. Adds ``passed`` and ``reason``.
    """
    n, c = F.col(new_auc), F.col(champion_auc)
    floor = c - F.lit(max_drop)
    passed = F.when(F.lit(disabled), F.lit(True))
    reason = F.when(F.lit(disabled), F.lit("gate disabled"))
    if min_auc is not None:
        passed = passed.when(n < F.lit(min_auc), F.lit(False))
        reason = reason.when(n < F.lit(min_auc), F.lit("below minimum valid_auc"))
    passed = passed.when(c.isNull(), F.lit(True)).when(n < floor, F.lit(False))
    reason = reason.when(c.isNull(), F.lit("no champion")).when(n < floor, F.lit("below champion floor"))
    if require_improvement:
        passed = passed.when(n <= c, F.lit(False))
        reason = reason.when(n <= c, F.lit("no improvement over champion"))
    return candidates.select("*", passed.otherwise(F.lit(True)).alias("passed"),
                             reason.otherwise(F.lit("passed vs champion")).alias("reason"))
