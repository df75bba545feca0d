"""The monitoring job (D1–D9, P33, J2): reference vs analysis → drift, decay, log checks → decision.

Every step is a DataFrame; the result is one decision row (plus its JSON
form). The drift table can be written as a CSV report (S8).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lendwise.functions.columns import common_feature_columns
from lendwise.operators import checks as C
from lendwise.operators import drift as D


def monitoring_decision(
    reference: DataFrame,
    analysis: DataFrame,
    events: DataFrame | None,
    order: Sequence[str],
    target: str = "target",
    prediction: str = "probability",
    timestamp: str | None = None,
    ignore: Sequence[str] = (),
    chunk_size: int = D.CHUNK_SIZE,
    drift_rate: float = D.DRIFT_ALERT_RATE,
    min_auc_drop: float = C.MIN_AUC_DROP,
    denied_threshold: float = C.DENIED_THRESHOLD,
    denied_offset: int = 0,
    denied_min_rate: float = C.DENIED_MIN_RATE,
    mean_score_check: bool = False,
    mean_score_above: float = C.MEAN_SCORE_RETRAIN_ABOVE,
    report_path: str | None = None,
    multivariate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(decision row, drift table).

    Features are the analysis columns also in the reference, minus
    timestamp / target / prediction (P33) and ``ignore`` (ids, ordering).
    Drift is decided by the reconstruction error of all features together
    (D2), numbers and categories alike; with fewer than two features, which
    have nothing to be projected on, or with ``multivariate`` off, by each
    feature's own distance (D3). The log checks (D6, D7) share one scan and
    run only when ``events`` is given; the mean-score check is opt-in and
    starts false.
    """
    feats = [c for c in common_feature_columns(reference, analysis, (timestamp, target, prediction))
             if c not in set(ignore) | set(order)]
    if multivariate and len(feats) > 1:
        drift = D.reconstruction_drift(reference, analysis, feats, order, chunk_size)
    else:
        drift = D.univariate_drift(reference, analysis, feats, order, chunk_size)
    if report_path:
        # the report and the alert summary read one materialised drift table
        from lendwise.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(drift.sparkSession)
        drift = drift.checkpoint(eager=True)
        from lendwise.sources.sinks import write_csv_report

        write_csv_report(drift, report_path)
    checks = [D.alert_summary(drift, rate_threshold=drift_rate),
              C.auc_decay(reference, analysis, target, prediction, min_auc_drop)]
    if events is not None:
        logged = C.log_checks(events, prediction, denied_threshold, denied_offset, denied_min_rate, mean_score_above)
        checks.append(logged if mean_score_check else logged.select(*[c for c in logged.columns if c.startswith("negado")]))
    return C.retrain_decision(*checks), drift
