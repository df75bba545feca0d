"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` over the bound test tables.

Keys are stable names listed with their SURVEY ids; ``__spark_entry__``
exposes this dict. Floating results are rounded so that two engines summing
in different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwise.functions import columns as CO
from lendwise.functions import features as X
from lendwise.functions.columns import LEAKAGE_COLUMNS
from lendwise.functions.dates import age_floor_days, calendar_age, strict_date, year_difference
from lendwise.functions.decisions import decision_band, rounded_probability
from lendwise.functions.ids import id_error, id_value
from lendwise.operators import checks as C
from lendwise.operators import dedup as W
from lendwise.operators import drift as D
from lendwise.operators import encoders as E
from lendwise.operators import joins as J
from lendwise.operators import labels as L
from lendwise.operators import metrics as M
from lendwise.operators import profile as PR
from lendwise.operators import requests as R
from lendwise.operators.ordering import chunk_numbers as _chunks
from lendwise.plans import assemble as A
from lendwise.plans import monitor as MON
from lendwise.plans import preparation as PREP
from lendwise.plans import train as T
from lendwise.session import scratch_path
from lendwise.sources import bindings as B
from lendwise.sources import readers as RD
from lendwise.sources import sinks as SK
from lendwise.streaming import scoring as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RATE_PLACES = 10


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _round(df: DataFrame, places: int = RATE_PLACES) -> DataFrame:
    from pyspark.sql.types import DoubleType, FloatType

    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- labels (A1–A5, JN1, JN5, P3/P4) -------------------------------------------------


@query("bad_rate_by_contract_type")
def bad_rate_by_contract_type(spark: SparkSession, sf: str) -> DataFrame:
    """S1 → P3/P4 → A4 → JN1 → A5: the flagship slice."""
    lab = L.contract_labels(B.instalments(spark, sf))
    con = B.contracts(spark, sf).select("id_contrato", "tipo_contrato")
    return _round(L.bad_rate_summary(con.join(lab, "id_contrato", "inner"), by=["tipo_contrato"]))


@query("contract_labels")
def contract_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the label table."""
    return L.contract_labels(B.instalments(spark, sf))


@query("ever30_labels")
def ever30_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return L.ever30_labels(B.instalments(spark, sf))


@query("over60_labels")
def over60_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A2."""
    return L.over60_labels(B.instalments(spark, sf))


@query("fpd_labels")
def fpd_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A3."""
    return L.fpd_labels(B.instalments(spark, sf))


@query("labels_outer_join")
def labels_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    """JN5: the three label tables joined outer, missing → 0."""
    inst = B.instalments(spark, sf)
    return L.outer_join_labels(L.ever30_labels(inst), L.over60_labels(inst), L.fpd_labels(inst))


@query("instalment_lateness")
def instalment_lateness(spark: SparkSession, sf: str) -> DataFrame:
    """P1/P3/P4 per instalment row."""
    inst = L.with_lateness(B.instalments(spark, sf))
    return inst.select("id_contrato", "numero_parcela", "data_prevista_pagamento", "data_real_pagamento", "atraso")


# --- joins, dedup and assembly (JN1–JN7, W1, W2, W4, M1–M3, D1, P9–P18) --------------


APP_ORDER = ("data_solicitacao", "event_id")


@query("training_set")
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    """M1 (JN1 + JN2 + JN4 over A4)."""
    return _round(A.training_set(B.contracts(spark, sf), B.instalments(spark, sf), B.profile(spark, sf),
                                 B.applications(spark, sf), application_order=APP_ORDER))


@query("notebook_training_set")
def notebook_training_set(spark: SparkSession, sf: str) -> DataFrame:
    """M2 (JN2 + JN1 over A2)."""
    return _round(A.notebook_training_set(B.contracts(spark, sf), B.instalments(spark, sf), B.profile(spark, sf)))


@query("credit_features")
def credit_features(spark: SparkSession, sf: str) -> DataFrame:
    """M3 on the M2 frame (encoder fit on the same frame, materialised once so fit and apply share it)."""
    df = A.notebook_training_set(B.contracts(spark, sf), B.instalments(spark, sf), B.profile(spark, sf))
    return _round(A.credit_features(T.training_frame(df)))


@query("latest_application")
def latest_application(spark: SparkSession, sf: str) -> DataFrame:
    """Last application per client by (data_solicitacao, event_id)."""
    return W.keep_last(B.applications(spark, sf), "id_cliente", APP_ORDER)


@query("first_instalment")
def first_instalment(spark: SparkSession, sf: str) -> DataFrame:
    """First instalment row per contract by (numero_parcela, due, paid, valor_pago)."""
    inst = B.instalments(spark, sf)
    return W.keep_first(inst, "id_contrato", ["numero_parcela", "data_prevista_pagamento", "data_real_pagamento", "valor_pago"])


@query("applications_merged")
def applications_merged(spark: SparkSession, sf: str) -> DataFrame:
    """D1 with applications as the base (JN3 on client; contract joins skipped: no contract key)."""
    return _round(A.merge_lending_tables(B.applications(spark, sf), B.profile(spark, sf),
                                         B.contracts(spark, sf), B.instalments(spark, sf)))


@query("contracts_merged")
def contracts_merged(spark: SparkSession, sf: str) -> DataFrame:
    """D1 with contracts as the base: JN3 profile + JN6 instalment means."""
    return _round(A.merge_lending_tables(B.contracts(spark, sf), B.profile(spark, sf),
                                         None, B.instalments(spark, sf)), 6)


@query("instalment_means")
def instalment_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of every numeric instalment column per contract."""
    return _round(J.numeric_means(B.instalments(spark, sf), "id_contrato"), 6)


@query("label_union")
def label_union(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered distinct union of two label columns."""
    s = B.scored_labels(spark, sf)
    return W.ordered_union_labels(s, "quality", s, "toxic")


REF_DAY = "2024-01-01"


@query("profile_features")
def profile_features(spark: SparkSession, sf: str) -> DataFrame:
    """P9, P10, P12, P14, P15 on the client profile."""
    p = B.profile(spark, sf)
    ref = F.lit(REF_DAY).cast("date")
    return _round(p.select(
        "id_cliente",
        X.yes_no_flag("possui_carro").alias("possui_carro_flag"),
        X.yes_no_flag("possui_carro", other=0).alias("feat_possui_carro"),
        X.monthly_income("renda_anual").alias("renda_mensal"),
        X.income_per_member("renda_anual", "qtd_membros_familia").alias("feat_renda_per_capita"),
        calendar_age("data_nascimento", ref).alias("idade"),
        year_difference("data_nascimento", ref).alias("idade_por_ano"),
        X.fill_constant("possui_carro", "Unknown").alias("possui_carro_filled"),
    ))


@query("contract_features")
def contract_features(spark: SparkSession, sf: str) -> DataFrame:
    """P11, P13, P16, P17, P18 on contracts ⟕ profile."""
    df = J.left_join_if_keyed(B.contracts(spark, sf), B.profile(spark, sf), "id_cliente")
    return _round(df.select(
        "id_contrato",
        X.instalment_to_income("valor_parcela", "renda_anual").alias("feat_comprometimento_renda"),
        age_floor_days("data_decisao", "data_nascimento").alias("feat_idade"),
        X.loan_to_value("valor_credito", "valor_bem").alias("feat_ltv"),
        X.risk_hour_flag("hora_solicitacao").alias("feat_hora_pico_fraude"),
        X.granted_ratio_pct("valor_credito", "valor_solicitado").alias("pct_concedido"),
    ))


# --- profiling (A7–A22, F2–F6, P6) ------------------------------------------------------


def _lateness(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_lateness(B.instalments(spark, sf))


@query("contracts_null_pct")
def contracts_null_pct(spark, sf):
    """A7 on contracts."""
    return PR.null_pct(B.contracts(spark, sf))


@query("profile_null_pct")
def profile_null_pct(spark, sf):
    """A7 on the client profile."""
    return PR.null_pct(B.profile(spark, sf))


@query("contracts_shape")
def contracts_shape(spark, sf):
    """Rows, columns, distinct and non-null client ids of contracts."""
    return PR.shape(B.contracts(spark, sf), "id_cliente")


@query("contract_type_counts")
def contract_type_counts(spark, sf):
    """A9 on one column."""
    return PR.value_counts(B.contracts(spark, sf), "tipo_contrato")


@query("profile_value_counts")
def profile_value_counts(spark, sf):
    """A9 on many columns in one pass."""
    return PR.value_counts_many(B.profile(spark, sf), ["tipo_renda", "possui_carro", "qtd_membros_familia"])


@query("term_counts")
def term_counts(spark, sf):
    """Rows per instalment number."""
    return PR.value_counts(B.instalments(spark, sf), "numero_parcela")


@query("describe_amounts")
def describe_amounts(spark, sf):
    """A10 on three contract amounts."""
    return PR.describe(B.contracts(spark, sf), ["valor_credito", "valor_parcela", "valor_bem"])


@query("income_histogram")
def income_histogram(spark, sf):
    """Annual income in bins of 20 000 from the minimum."""
    return PR.fixed_width_histogram(B.profile(spark, sf), "renda_anual", 20000.0)


@query("instalment_value_histogram")
def instalment_value_histogram(spark, sf):
    """F3 + A11: instalment value clipped at its P99, bins of 2 000 from 0."""
    clipped = PR.clip_at_quantile(B.contracts(spark, sf), "valor_parcela", 0.99)
    return PR.fixed_width_histogram(clipped, "valor_parcela", 2000.0, origin=0.0)


@query("age_histogram")
def age_histogram(spark, sf):
    """A11 with width 1 on calendar ages."""
    ages = B.profile(spark, sf).select(calendar_age("data_nascimento", F.lit(REF_DAY).cast("date")).alias("idade"))
    return PR.fixed_width_histogram(ages, "idade", 1.0, stop_pad=2.0)


@query("lateness_equal_bins")
def lateness_equal_bins(spark, sf):
    """F3 + A12: days late clipped at P99 in 40 equal bins."""
    return PR.equal_bins_histogram(PR.clip_at_quantile(_lateness(spark, sf), "atraso", 0.99), "atraso", 40)


@query("monthly_decisions")
def monthly_decisions(spark, sf):
    """A13 (month-end labels) of contract decision dates."""
    return PR.monthly_counts(B.contracts(spark, sf), "data_decisao", label="end")


@query("monthly_payments")
def monthly_payments(spark, sf):
    """F2 + A13 (month-start labels) of actual payment dates."""
    paid = PR.drop_null_rows(B.instalments(spark, sf), ["data_real_pagamento"])
    return PR.monthly_counts(paid, "data_real_pagamento", label="start")


@query("goods_value_null_fraction")
def goods_value_null_fraction(spark, sf):
    """A14."""
    return PR.null_fraction(B.contracts(spark, sf), "valor_bem")


@query("paid_early_fraction")
def paid_early_fraction(spark, sf):
    """Share of instalments paid before due; unpaid counts as false."""
    return PR.predicate_fraction(B.instalments(spark, sf),
                                 F.col("data_real_pagamento") < F.col("data_prevista_pagamento"), "fraction")


@query("credit_by_contract_type")
def credit_by_contract_type(spark, sf):
    """Contracts and median credit per type."""
    return _round(PR.category_count_median(B.contracts(spark, sf), "tipo_contrato", "valor_credito", "id_contrato"), 6)


@query("credit_box_by_type")
def credit_box_by_type(spark, sf):
    """A17 per contract type."""
    return _round(PR.box_stats(B.contracts(spark, sf), "valor_credito", ["tipo_contrato"]), 6)


@query("lateness_box")
def lateness_box(spark, sf):
    """A17 overall, on days late."""
    return _round(PR.box_stats(_lateness(spark, sf), "atraso"), 6)


@query("lateness_summary")
def lateness_summary(spark, sf):
    """A18."""
    return PR.lateness_summary(_lateness(spark, sf), "atraso")


@query("contract_status_values")
def contract_status_values(spark, sf):
    """A19."""
    return PR.distinct_values(B.contracts(spark, sf), "status_contrato")


@query("profile_missingness")
def profile_missingness(spark, sf):
    """A20."""
    return PR.missingness_patterns(B.profile(spark, sf))


@query("lateness_kde")
def lateness_kde(spark, sf):
    """A21 on days late clipped at P99."""
    return PR.kde_grid(PR.clip_at_quantile(_lateness(spark, sf), "atraso", 0.99), "atraso")


@query("top_clients")
def top_clients(spark, sf):
    """the 20 clients with most contracts, pct over all contracts."""
    return PR.top_categories(B.contracts(spark, sf), "id_cliente", 20)


@query("complete_profiles")
def complete_profiles(spark, sf):
    """profiles with income and car flag present."""
    return _round(PR.drop_null_rows(B.profile(spark, sf), ["renda_anual", "possui_carro"]))


@query("contracts_head")
def contracts_head(spark, sf):
    """first five contracts by id."""
    return _round(PR.head(B.contracts(spark, sf), ["id_contrato"], 5))


@query("predictions_first_n")
def predictions_first_n(spark, sf):
    """first 1 000 prediction events by (event_ts, event_id)."""
    return _round(PR.head(B.predictions(spark, sf), ["event_ts", "event_id"], 1000))


@query("income_median_fill")
def income_median_fill(spark, sf):
    """NULL income replaced by the median income."""
    return _round(E.fill_with_quantile(B.profile(spark, sf), ["renda_anual"], 0.5))


@query("income_clip_p99")
def income_clip_p99(spark, sf):
    """profiles with income ≤ its P99."""
    return _round(PR.clip_at_quantile(B.profile(spark, sf), "renda_anual", 0.99))


# --- metrics, ordering and monitoring (M14–M17, M19, M20, W3, D2–D8, J2) ---------------


EVENT_ORDER = ["event_ts", "event_id"]
DRIFT_FEATURES = ["value", "event_type", "hora"]


@query("auc_scored_labels")
def auc_scored_labels(spark, sf):
    """Exact AUC of the length score for both document labels."""
    s = B.scored_labels(spark, sf)
    q = M.auc_table(s, "quality", "score").select(F.lit("quality").alias("target"), "*")
    t = M.auc_table(s, "toxic", "score").select(F.lit("toxic").alias("target"), "*")
    return _round(q.unionByName(t), 10)


@query("auc_by_lang")
def auc_by_lang(spark, sf):
    """M14 per group (language)."""
    return _round(M.auc_table(B.scored_labels(spark, sf), "quality", "score", by=["lang"]), 10)


@query("auc_predictions")
def auc_predictions(spark, sf):
    """M14 on the prediction log (continuous scores, many ties)."""
    return _round(M.auc_table(B.predictions(spark, sf), "target", "probability"), 10)


@query("class_report_05")
def class_report_05(spark, sf):
    """Per-class precision / recall / F1 at probability > 0.5."""
    p = B.predictions(spark, sf).withColumn("pred", (F.col("probability") > 0.5).cast("int"))
    return _round(M.per_class_prf(p, "target", "pred"), 10)


@query("confusion_03")
def confusion_03(spark, sf):
    """Confusion matrix at probability > 0.3."""
    return M.confusion_matrix(B.predictions(spark, sf), "target", "probability", 0.3)


@query("threshold_sweep")
def threshold_sweep(spark, sf):
    """Thresholds 0.3 / 0.5 / 0.9 with >=."""
    return _round(M.threshold_sweep(B.predictions(spark, sf), "target", "probability"), 10)


def _runs(spark, sf):
    s = B.scored_labels(spark, sf).withColumn("version", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))
    runs = M.auc_table(s, "quality", "score", by=["lang", "version"])
    return runs.select(
        F.col("lang").alias("model"), "version",
        F.when(F.col("version") % 7 == 0, F.lit("Production")).otherwise(F.lit("None")).alias("stage"),
        F.col("auc").alias("valid_auc"),
    )


@query("champion_runs")
def champion_runs(spark, sf):
    """M19 over run metrics derived per (language, source) from the scored labels."""
    return _round(C.champion(_runs(spark, sf)), 10)


@query("promotion_gate")
def promotion_gate(spark, sf):
    """Each language's overall AUC gated against its champion run."""
    cand = M.auc_table(B.scored_labels(spark, sf), "quality", "score", by=["lang"]).select(
        F.col("lang").alias("model"), F.col("auc").alias("new_auc"))
    joined = cand.join(C.champion(_runs(spark, sf)), "model", "left")
    return _round(C.promotion_gate(joined, min_auc=0.4), 10)


@query("event_chunks")
def event_chunks(spark, sf):
    """500-row chunks of the prediction log in time order."""
    return _chunks(B.predictions(spark, sf).select("event_id", "event_ts"), EVENT_ORDER, 500)


@query("univariate_drift")
def univariate_drift(spark, sf):
    """D3: Jensen-Shannon drift per feature and 500-row chunk."""
    ref, ana = B.monitoring_frames(spark, sf)
    return D.univariate_drift(ref, ana, DRIFT_FEATURES, EVENT_ORDER)


@query("drift_alert_summary")
def drift_alert_summary(spark, sf):
    """D4."""
    ref, ana = B.monitoring_frames(spark, sf)
    return _round(D.alert_summary(D.univariate_drift(ref, ana, DRIFT_FEATURES, EVENT_ORDER)), 10)


@query("reconstruction_drift")
def reconstruction_drift(spark, sf):
    """PCA reconstruction error of numbers and categories per chunk (ML fit: rows-only check)."""
    ref, ana = B.monitoring_frames(spark, sf)
    return D.reconstruction_drift(ref, ana, ["value", "hora", "event_type"], EVENT_ORDER)


@query("auc_decay")
def auc_decay(spark, sf):
    """Reference vs analysis AUC."""
    ref, ana = B.monitoring_frames(spark, sf)
    return _round(C.auc_decay(ref, ana, "target", "probability"), 10)


@query("denied_rate")
def denied_rate(spark, sf):
    """D6 with the documented defaults (threshold 0.5, no offset)."""
    return _round(C.denied_rate(B.predictions(spark, sf)), 10)


@query("denied_rate_as_coded")
def denied_rate_as_coded(spark, sf):
    """D6 with the as-coded pair (threshold 0.1, denominator + 10)."""
    return _round(C.denied_rate(B.predictions(spark, sf), threshold=0.1, denominator_offset=10), 10)


@query("mean_score")
def mean_score(spark, sf):
    """D7."""
    return _round(C.mean_score(B.predictions(spark, sf)), 10)


def _decision(spark, sf):
    ref, ana = B.monitoring_frames(spark, sf)
    drift = D.alert_summary(D.univariate_drift(ref, ana, DRIFT_FEATURES, EVENT_ORDER))
    return C.retrain_decision(drift, C.auc_decay(ref, ana, "target", "probability"), C.log_checks(B.predictions(spark, sf)))


@query("retrain_decision")
def retrain_decision(spark, sf):
    """OR of drift, decay, denied-rate and mean-score flags."""
    return _round(_decision(spark, sf), 10)


@query("decision_report_json")
def decision_report_json(spark, sf):
    """The decision row as JSON (booleans and counts only, stable text)."""
    d = _decision(spark, sf).select("should_retrain", "drift_detected", "decay_detected", "n_alerts",
                                    "negado_count", "negado_denominator")
    return C.decision_report(d)


# --- requests, decisions and the prediction log (J1–J3, P8, P19–P25, P30, D9, F7, F9, JN8) --


PROCESSING_DATE = "2024-02-01"


def _scored(spark, sf):
    msgs = B.request_messages(spark, sf)
    norm = R.normalise(R.decode_envelope(msgs), processing_date=F.lit(PROCESSING_DATE).cast("date"))
    return R.score_requests(norm, event_ts=F.col("timestamp"))


@query("decision_bands")
def decision_bands(spark, sf):
    """P19 + P20 on the prediction log."""
    p = B.predictions(spark, sf)
    return p.select("event_id", rounded_probability("probability").alias("probability_4"),
                    decision_band("probability").alias("threshold_decision"))


@query("request_envelopes")
def request_envelopes(spark, sf):
    """Envelope kind and decode errors per message."""
    d = R.decode_envelope(B.request_messages(spark, sf))
    return d.select("key", "envelope", "decode_error",
                    F.get_json_object("payload", "$.tipo_contrato").alias("tipo_contrato"))


@query("request_ids")
def request_ids(spark, sf):
    """P8 on the client id text of each request payload."""
    d = R.decode_envelope(B.request_messages(spark, sf))
    raw = F.get_json_object("payload", "$.id_cliente")
    return d.select("key", id_value(raw, 0).alias("id_cliente"), id_error(raw).alias("id_error"))


@query("request_normalized")
def request_normalized(spark, sf):
    """P21 + P24 + J3: typed requests with rejection reasons."""
    msgs = B.request_messages(spark, sf)
    norm = R.normalise(R.decode_envelope(msgs), processing_date=F.lit(PROCESSING_DATE).cast("date"))
    return norm.select("key", *R.field_names(), "reasons")


@query("prediction_events_log")
def prediction_events_log(spark, sf):
    """ST7 + P25 + P30: the prediction-events table of a batch replay."""
    return R.event_log(_scored(spark, sf))


@query("prediction_requests_log")
def prediction_requests_log(spark, sf):
    """S11 second table: the prediction-requests log."""
    return R.request_log(_scored(spark, sf))


@query("rejected_requests")
def rejected_requests(spark, sf):
    """ST4 / F9: rejected messages with reasons (raw value kept in the dead-letter sink)."""
    return R.dead_letters(_scored(spark, sf)).select("event_id", "key", "offset", "reasons")


@query("events_join_requests")
def events_join_requests(spark, sf):
    """JN8: events ⋈ requests on event_id, counted per decision (both logs come from one scoring, written once)."""
    path = scratch_path(spark, "scored")
    _scored(spark, sf).drop("value", "payload").write.parquet(path)
    s = RD.read_parquet(spark, path)
    ev = R.event_log(s).select("event_id", "threshold_decision", "probability")
    rq = R.request_log(s).select("event_id", "tipo_contrato")
    j = ev.join(rq, "event_id", "inner")
    return _round(j.groupBy("threshold_decision", "tipo_contrato").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("avg_probability")), 8)


def _evaluator(spark, sf):
    d = R.decode_envelope(B.request_messages(spark, sf))
    return R.evaluator_payload(R.payload_columns(d, R.field_names()))


@query("evaluator_accounting")
def evaluator_accounting(spark, sf):
    """P22 + P23 + D9: evaluator payloads built, scored and dropped."""
    return R.scoring_accounting(_evaluator(spark, sf))


@query("evaluator_top_missing")
def evaluator_top_missing(spark, sf):
    """most frequent missing required fields among dropped rows."""
    return R.top_missing_fields(_evaluator(spark, sf), 8)


# --- sources, sinks and streaming (S1–S3, S6–S8, S10, S11, S14, S15, ST1–ST5) ------------


REPORT_SCHEMA = ("tipo_contrato string, n_contracts bigint, target_fpd_rate double, target_fpd_sum bigint, "
                 "target_ever30mob03_rate double, target_ever30mob03_sum bigint, "
                 "target_over60mob06_rate double, target_over60mob06_sum bigint")


@query("csv_report_roundtrip")
def csv_report_roundtrip(spark, sf):
    """S8 → S3 → S2: the flagship report written as CSV and read back by suffix dispatch."""
    uri = scratch_path(spark, "report") + "/bad_rate.csv"
    SK.write_csv_report(bad_rate_by_contract_type(spark, sf), uri, partitions=1)
    return RD.read_table(spark, uri, schema=REPORT_SCHEMA)


@query("prefix_merged")
def prefix_merged(spark, sf):
    """S6 + S7 + S1 + D1: lending tables written under a prefix, discovered by name, merged."""
    root = scratch_path(spark, "prefix")
    B.applications(spark, sf).write.parquet(f"{root}/base_submissao_new.parquet")
    B.profile(spark, sf).write.parquet(f"{root}/base_cadastral_new.parquet")
    tables = RD.load_prefix_tables(spark, root, "_new.parquet")
    base = RD.require_non_empty(RD.require_columns(tables["base_submissao"], ["id_cliente"], "base_submissao"))
    return _round(A.merge_lending_tables(base, tables.get("base_cadastral"), tables.get("historico_emprestimos"),
                                         tables.get("historico_parcelas")))


# Messages of one input file of the stream: what a micro-batch holds, however many messages there are.
MESSAGES_PER_FILE = 1_000_000


@query("stream_prediction_events")
def stream_prediction_events(spark, sf):
    """ST1–ST4 + S10/S11/S14/S15: request files streamed in micro-batches into the dual log, read back."""
    root = scratch_path(spark, "stream")
    files = max(4, -(-B.predictions(spark, sf).count() // MESSAGES_PER_FILE))
    B.request_messages(spark, sf).repartition(files, "partition", "offset").write.parquet(f"{root}/in")
    msgs = ST.file_messages(spark, f"{root}/in", max_files_per_trigger=1)
    scored = ST.scored_stream(msgs, processing_date=F.lit(PROCESSING_DATE).cast("date"), event_ts=F.col("timestamp"))
    q = ST.start_scoring(scored, f"{root}/ckpt", f"{root}/events", f"{root}/requests", f"{root}/dead",
                         trigger={"availableNow": True}, partitions=2)
    q.awaitTermination()
    return RD.read_parquet(spark, f"{root}/events").drop("run_id", "batch_id")


# --- model jobs (M8–M13, M18; rows-only checks) ---------------------------------------------


TARGET = L.OVER60
# Kept out of every model input: ids, the other labels, the split flag and what is known only after approval.
LEAKS = ["id_contrato", "event_id", L.FPD, L.EVER30, "is_train", *LEAKAGE_COLUMNS,
         *[f"feat_{c}_enc" for c in LEAKAGE_COLUMNS]]
# The fitted model of the last application and folder: the three gbt_ queries share one fit.
_FITTED: dict = {}


def _model_frame(spark, sf):
    ts = A.training_set(B.contracts(spark, sf), B.instalments(spark, sf), B.profile(spark, sf),
                        B.applications(spark, sf), application_order=APP_ORDER)
    return A.split_credit_features(ts, "id_contrato", 0.8, 42)


def _fit(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED.clear()
        df = T.fitting_frame(T.training_frame(_model_frame(spark, sf)))
        pipe, names = T.prepared_pipeline(df, TARGET, exclude=LEAKS)
        _FITTED[key] = df, pipe.fit(df.where("is_train")), names
    return _FITTED[key]


@query("instalments_merged")
def instalments_merged(spark, sf):
    """D1 with a base that knows its contract: first instalments ⟕ profile ⟕ contracts (new columns) ⟕ instalment means."""
    base = B.instalments(spark, sf).where("numero_parcela = 1").select("id_contrato", "id_cliente", "valor_pago")
    return _round(A.merge_lending_tables(base, B.profile(spark, sf), B.contracts(spark, sf), B.instalments(spark, sf)), 6)


@query("labels_left_join")
def labels_left_join(spark, sf):
    """JN7: training rows keep a NULL label where the label table has no row for the contract."""
    contracts = B.contracts(spark, sf)
    finished = contracts.where(F.col("status_contrato") == "F").select("id_contrato")
    labels = L.contract_labels(B.instalments(spark, sf)).join(finished, "id_contrato", "left_semi")
    frame = contracts.select("id_contrato", "tipo_contrato")
    return J.left_join_labels(frame, labels.select("id_contrato", L.FPD, L.EVER30))


@query("train_split")
def train_split(spark, sf):
    """M8: stateless md5 split, seed 42, 80 % train — counts per side and class."""
    df = _model_frame(spark, sf)
    return df.groupBy("is_train", TARGET).agg(F.count(F.lit(1)).alias("n"))


@query("gbt_validation_scores")
def gbt_validation_scores(spark, sf):
    """Boosted trees fit on the train side, scores on the validation side."""
    df, model, _ = _fit(spark, sf)
    return T.score(model, df.where(~F.col("is_train"))).select("id_contrato", TARGET, "probability_1")


@query("gbt_validation_metrics")
def gbt_validation_metrics(spark, sf):
    """M14 + M15 on the validation scores: AUC and per-class report at 0.5."""
    df, model, _ = _fit(spark, sf)
    s = T.score(model, df.where(~F.col("is_train"))).withColumn("pred", (F.col("probability_1") > 0.5).cast("int"))
    s = T.training_frame(s.select(TARGET, "probability_1", "pred"))  # both metrics read the scores more than once
    auc = M.auc_table(s, TARGET, "probability_1").select("auc").scalar()
    return M.per_class_prf(s, TARGET, "pred").select("*", auc.alias("valid_auc"))


@query("gbt_feature_importance")
def gbt_feature_importance(spark, sf):
    """Top-15 importances."""
    df, model, _ = _fit(spark, sf)
    return T.feature_importance(model, df, 15)


@query("hpo_search")
def hpo_search(spark, sf):
    """5 seeded random trials × 3-fold CV over the library's ranges."""
    df = T.training_frame(_model_frame(spark, sf).where("is_train"))
    search = T.random_search(df, TARGET, exclude=LEAKS)
    rows = [(i, float(m)) for i, m in enumerate(search.avgMetrics)]
    return spark.createDataFrame(rows, "trial int, mean_auc double")


# A logistic link with stated coefficients: what M12 ships to the executors here.
SCORER_FEATURES = ("valor_credito", "valor_parcela", "hora_solicitacao", "feat_ltv")
SCORER_COEFFICIENTS = (2e-06, -1e-05, 0.03, -0.4)
SCORER_INTERCEPT = -0.25


@query("local_model_scores")
def local_model_scores(spark, sf):
    """A scoring object shipped to executors and applied on Arrow batches (missing inputs count as 0)."""
    scorer = T.LinearScorer(SCORER_COEFFICIENTS, SCORER_INTERCEPT)
    held = _model_frame(spark, sf).where(~F.col("is_train"))
    scored = T.score_with_local_model(held, list(SCORER_FEATURES), lambda: scorer)
    return _round(scored.select("id_contrato", TARGET, "prediction_proba"), 9)


# Inputs of the preparation query: numbers with gaps, texts with gaps.
SLOT_NUMBERS = ("valor_bem", "renda_anual", "hora_solicitacao")
SLOT_TEXTS = ("tipo_contrato", "possui_carro", "tipo_renda")


@query("prepared_slots")
def prepared_slots(spark, sf):
    """M4 + M5 + M6 + M9: preparation fitted on the train side, the validation rows' vectors slot by slot."""
    ts = A.training_set(B.contracts(spark, sf), B.instalments(spark, sf), B.profile(spark, sf), application_order=APP_ORDER)
    # texts take gaps, and a category that only validation rows hold
    gaps = F.when(F.col("id_contrato") % 11 != 0, F.col("tipo_contrato"))
    frame = E.hash_split(ts.withColumn("tipo_contrato", gaps), "id_contrato", 0.8, 42)
    frame = T.training_frame(frame.withColumn("tipo_renda", F.when(F.col("is_train") | (F.col("id_contrato") % 7 != 0),
                                                                   F.col("tipo_renda")).otherwise("never seen")))
    model = PREP.preparation(SLOT_NUMBERS, SLOT_TEXTS).fit(frame.where("is_train"))
    return _round(PREP.vector_slots(model.transform(frame.where("NOT is_train")), "id_contrato"), 6)


@query("strict_decision_dates")
def strict_decision_dates(spark, sf):
    """Decision dates written as text and parsed strictly (a malformed one would fail the job)."""
    text = B.contracts(spark, sf).select("id_contrato", F.date_format("data_decisao", "yyyy-MM-dd").alias("t"))
    return text.select("id_contrato", strict_date("t").alias("data_decisao"))


@query("aligned_features")
def aligned_features(spark, sf):
    """Contract rows in a model's column order; absent columns take their default or the fill."""
    names = ["hora_solicitacao", "feat_unknown", "valor_credito", "canal_venda", "id_contrato"]
    return _round(CO.align_columns(B.contracts(spark, sf), names, {"canal_venda": "Country-wide"}, fill=0))


@query("dictionary_projection")
def dictionary_projection(spark, sf):
    """S16 + S17: contracts cut to the columns that a dictionary file names, and the required key."""
    path = scratch_path(spark, "dictionary")
    names = [(" valor_credito ", "x"), ("tipo_contrato", "y"), ("tipo_contrato", "z"), ("  ", "-"), (None, "-"), ("not_there", "-")]
    spark.createDataFrame(names, "coluna string, descricao string").write.csv(path, sep=";", header=True)
    keep = [r["coluna"] for r in RD.dictionary_columns(spark, path).collect()]
    return _round(RD.project_to_columns(B.contracts(spark, sf), keep, required=["id_contrato"]))


@query("table_sink_lifecycle")
def table_sink_lifecycle(spark, sf):
    """S10 + S12 + S13 + ST3: create, append, reconcile, replay, compact, replay again — every prediction once."""
    import uuid

    rows = B.predictions(spark, sf).select("event_id", "event_ts", "probability", "event_type")
    where = scratch_path(spark, "table-sink")
    name = f"prediction_log_{uuid.uuid4().hex}"
    old = [("event_id", "bigint"), ("event_ts", "timestamp_ntz"), ("probability", "double")]

    def batch(k):
        return rows.where(F.col("event_id") % 5 == k)

    sink = SK.TableSink(spark, name, old, where)
    sink.append(batch(0).drop("event_type"), 0, "run-a")
    sink = SK.TableSink(spark, name, [*old, ("event_type", "string")], where)  # a column more
    for k in (1, 2, 2):  # batch 2 is replayed
        sink.append(batch(k), k, "run-a")
    sink.compact()
    sink.append(batch(2), 2, "run-a")  # replayed after it was compacted
    sink.append(batch(3), 0, "run-b")  # another writer's batch 0
    sink.append(batch(4), 3, "run-a")
    return _round(sink.read(), 10)


# --- the monitoring job and remaining preparation queries (D8 + P33, M5) ---------------------


@query("monitoring_job")
def monitoring_job(spark, sf):
    """D8 end to end by the fallback detector: P33 feature choice, D3/D4 drift, D5 decay, D6 denied rate, drift report."""
    ref, ana = B.monitoring_frames(spark, sf)
    decision, _ = MON.monitoring_decision(ref, ana, B.predictions(spark, sf), EVENT_ORDER,
                                          ignore=["event_id"], timestamp="event_ts", multivariate=False,
                                          report_path=scratch_path(spark, "drift") + "/drift.csv")
    return _round(decision, 10)


@query("monitoring_job_multivariate")
def monitoring_job_multivariate(spark, sf):
    """D8 end to end: drift decided by the reconstruction error of all features (D2), D5 to D7 beside it."""
    ref, ana = B.monitoring_frames(spark, sf)
    decision, _ = MON.monitoring_decision(ref, ana, B.predictions(spark, sf), EVENT_ORDER, ignore=["event_id"],
                                          timestamp="event_ts", mean_score_check=True)
    return _round(decision, 10)


@query("mode_fill")
def mode_fill(spark, sf):
    """M5: NULL car flags replaced by the most frequent flag (ties → smallest)."""
    return E.fill_with_mode(B.profile(spark, sf).select("id_cliente", "possui_carro"), ["possui_carro"])


@query("training_run")
def training_run(spark, sf):
    """Training job end to end (M1, M3, M8–M11, M14, M15, M19, M20) against derived champion runs."""
    s = B.scored_labels(spark, sf).withColumn("version", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))
    runs = M.auc_table(s, "quality", "score", by=["version"]).select(
        F.lit("credit_default").alias("model"), "version",
        F.when(F.col("version") % 7 == 0, F.lit("Production")).otherwise(F.lit("None")).alias("stage"),
        F.col("auc").alias("valid_auc"))
    _, report = T.training_run(B.contracts(spark, sf), B.instalments(spark, sf), B.profile(spark, sf),
                               B.applications(spark, sf), runs=runs, application_order=APP_ORDER)
    return report


@query("train_split_stratified")
def train_split_stratified(spark, sf):
    """M8 option: exact per-class 80 % train counts (seeded md5 order, distributed numbering)."""
    ts = A.training_set(B.contracts(spark, sf), B.instalments(spark, sf), application_order=APP_ORDER)
    split = E.stratified_split(ts.select("id_contrato", TARGET), "id_contrato", TARGET, 0.8, 42)
    return split.groupBy("is_train", TARGET).agg(F.count(F.lit(1)).alias("n"))
