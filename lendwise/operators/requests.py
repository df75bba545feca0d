"""Scoring requests: decode, normalise, validate, score, decide and project to the log.

All steps are column expressions over a message DataFrame ``(key, value,
topic, partition, offset, timestamp)``; the same function serves a batch
replay (ST7) and every streaming micro-batch (ST1). No row goes through
Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.functions.decisions import decision_band, rounded_probability
from lendwise.functions.ids import id_error, id_value, lenient_double
from lendwise.functions.payload import (
    API_FLOAT_FIELDS,
    API_INT_FIELDS,
    API_OPTIONAL_FIELDS,
    API_REQUIRED_FIELDS,
    ENVELOPE_KEYS,
    LOG_TYPES,
    METADATA_COLUMNS,
    REQUEST_FIELDS,
    REQUIRED_FALLBACKS,
    default_text,
)

ID_FIELDS = frozenset(f.name for f in REQUEST_FIELDS if f.kind == "id")


def _kind(v: Column) -> Column:
    """The JSON kind of a variant: STRING, BIGINT, DECIMAL(…), DOUBLE, BOOLEAN, VOID (JSON null), OBJECT<…>, ARRAY<…>."""
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False))


def _members(names: Sequence[str], kind: str) -> str:
    return "struct<" + ", ".join(f"`{n}`: {kind}" for n in names) + ">"


def decode_envelope(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``application`` (variant), ``payload`` (its JSON text), ``envelope`` and ``decode_error``.

    The value must be a JSON object; the first of payload/application/data/
    body holding an object is the application, else the whole object.
    NULL, bad JSON and non-objects get a ``decode_error`` and NULL payload.
    Each message is parsed once; everything later reads the variant.
    Of a key that is repeated in one object the last value counts, as in any
    lenient JSON reader (a session setting of the variant parser).
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = messages.select("*", F.try_parse_json(F.col(value).cast("string")).alias("__v"))
    v = F.col("__v")
    opened = parsed.select("*", _is_object(v).alias("__object"),
                           F.try_variant_get(v, "$", _members(ENVELOPE_KEYS, "variant")).alias("__e"))
    kind = F.when(~F.col("__object"), F.lit(None).cast("string"))
    chosen = F.when(~F.col("__object"), F.lit(None).cast("variant"))
    for k in ENVELOPE_KEYS:
        kind = kind.when(_is_object(F.col(f"__e.{k}")), F.lit(k))
        chosen = chosen.when(F.col("__kind") == k, F.col(f"__e.{k}"))
    err = (
        F.when(F.col(value).isNull(), F.lit("empty value"))
        .when(v.isNull(), F.lit("invalid JSON"))
        .when(~F.col("__object"), F.lit("value must be a JSON object"))
    )
    told = opened.select("*", kind.otherwise(F.lit("bare")).alias("__kind"))
    picked = told.select("*", chosen.otherwise(v).alias("application"), err.alias("decode_error"))
    return picked.select(*messages.columns, "application", F.to_json("application").alias("payload"),
                         F.col("__kind").alias("envelope"), "decode_error")


def normalise(decoded: DataFrame, processing_date: Column | None = None, application: str = "application") -> DataFrame:
    """P21 + P24 + P8 + J3: typed request columns and ``reasons`` (array of rejection reasons).

    Absent keys take the default payload; an explicit NULL id_cliente
    becomes 0; an empty/NULL data_decisao becomes ``processing_date``
    (default: today, UTC). Text fields must be JSON strings (a number, a
    flag or an object is no text), required ones non-NULL; numbers may come
    as JSON numbers or as text and must parse; integers may not have a
    fractional part.

    The application is read from its variant member by member, twice as one
    struct: as variants, which tell an absent key from a JSON null and a
    string from any other kind, and as texts. Nothing is parsed again.
    """
    today = processing_date if processing_date is not None else F.current_date()
    names = [f.name for f in REQUEST_FIELDS]
    keep = [c for c in decoded.columns if c not in {*names, application}]
    app = F.col(application)
    opened = decoded.select(*keep, F.try_variant_get(app, "$", _members(names, "variant")).alias("__m"),
                            F.try_variant_get(app, "$", _members(names, "string")).alias("__s"))

    def text(f) -> Column:
        """The member as text, the default where its key is absent; NULL if a text field holds another kind."""
        held, member = F.col(f"__s.{f.name}"), F.col(f"__m.{f.name}")
        default = default_text(f.default)
        if f.kind == "str":
            held = F.when(_kind(member) == "STRING", held)
        return held if default is None else F.when(member.isNull(), F.lit(default)).otherwise(held)

    def no_text(f) -> Column:
        return ~_kind(F.col(f"__m.{f.name}")).isin("STRING", "VOID")

    texts = [f for f in REQUEST_FIELDS if f.kind == "str"]
    wrong = F.array_compact(F.array(*[F.when(no_text(f), F.lit(f.name)) for f in texts]))
    with_text = opened.select(*keep, wrong.alias("__wrong"), *[text(f).alias(f"__t_{f.name}") for f in REQUEST_FIELDS])
    fixes = {
        "__t_id_cliente": F.coalesce(F.col("__t_id_cliente"), F.lit("0")),
        "__t_data_decisao": F.when(F.col("__t_data_decisao").isNull() | (F.col("__t_data_decisao") == ""),
                                   F.date_format(today, "yyyy-MM-dd")).otherwise(F.col("__t_data_decisao")),
    }
    with_text = with_text.withColumns(fixes)
    cols, reasons = [], []
    for f in REQUEST_FIELDS:
        t = F.col(f"__t_{f.name}")
        if f.kind == "id":
            cols.append(id_value(t, default=f.default).alias(f.name))
            reasons.append(F.when(id_error(t).isNotNull(), F.lit(f"{f.name}: numeric id expected")))
        elif f.kind == "str":
            cols.append(t.alias(f.name))
            if f.required:
                missing = t.isNull() & ~F.array_contains("__wrong", f.name)
                reasons.append(F.when(missing, F.lit(f"{f.name}: required")))
        elif f.kind == "float":
            d = lenient_double(t)
            d = F.when(~F.isnan(d), d)  # NaN is no amount: it would sort above every threshold
            cols.append(d.alias(f.name))
            bad = (t.isNull() & F.lit(f.required)) | (t.isNotNull() & d.isNull())
            reasons.append(F.when(bad, F.lit(f"{f.name}: number expected")))
        else:
            d = t.try_cast("double")
            whole = d.isNotNull() & (d == F.floor(d)) & F.trim(t).rlike(r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$")
            n = F.when(whole, d).try_cast("int")  # out of range: NULL, a rejection like any other bad number
            cols.append(n.alias(f.name))
            bad = (t.isNull() & F.lit(f.required)) | (t.isNotNull() & n.isNull())
            reasons.append(F.when(bad, F.lit(f"{f.name}: integer expected")))
    decode_reason = F.when(F.col("decode_error").isNotNull(), F.col("decode_error"))
    not_text = F.transform(F.col("__wrong"), lambda n: F.concat(n, F.lit(": text expected")))
    all_reasons = F.concat(F.array_compact(F.array(decode_reason, *reasons)), not_text)
    final = F.when(F.col("decode_error").isNotNull(), F.array(decode_reason)).otherwise(all_reasons).alias("reasons")
    # One-element ``explode``: a generator boundary, so a later filter on ``reasons``
    # (valid / rejected split) is evaluated on the computed column instead of being
    # pushed below with the whole validation inlined into the predicate. Only the
    # reasons pass through it; the columns stay in a projection.
    checked = with_text.select(*keep, *cols, final.alias("__reasons"))
    return checked.select(*keep, *names, F.explode(F.array("__reasons")).alias("reasons"))


def request_ids(df: DataFrame, key: str = "key") -> Column:
    """P30 / ST5: the message key, else a hash of (topic, partition, offset) — stable on replay."""
    fallback = F.sha2(F.concat_ws("|", F.col("topic").cast("string"), F.col("partition").cast("string"),
                                  F.col("offset").cast("string")), 256)
    k = F.col(key).cast("string")
    return F.when(k.isNull() | (k == ""), fallback).otherwise(k)


def default_scorer(df: DataFrame) -> Column:
    """Plain expression scorer for SQL-checked runs: min(valor_credito / 500, 1)."""
    return F.least(F.col("valor_credito") / F.lit(500.0), F.lit(1.0))


def score_requests(normalised: DataFrame, scorer: Callable[[DataFrame], Column] = default_scorer,
                   event_ts: Column | None = None, model_name: str = "credit_default",
                   model_stage: str = "Production") -> DataFrame:
    """Score valid rows; add metadata (P30), response (P19 band on the unrounded score, P20 rounding).

    Rejected rows keep NULL response columns; callers split on ``reasons``.
    """
    valid = F.size(F.col("reasons")) == 0
    p = F.when(valid, scorer(normalised))
    rid = request_ids(normalised)
    return normalised.select(
        "*",
        rid.alias("event_id"),
        (event_ts if event_ts is not None else F.current_timestamp()).alias("event_ts"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_stage).alias("model_stage"),
        rid.alias("request_id"),
        rounded_probability(p).alias("probability"),
        decision_band(p).alias("threshold_decision"),
        F.when(valid, F.lit("success")).otherwise(F.lit("rejected")).alias("status"),
    )


def event_log(scored: DataFrame) -> DataFrame:
    """P25: the prediction-events table (metadata + response + request fields, fixed order and types)."""
    meta = [F.col(n).alias(n) for n, _ in METADATA_COLUMNS]
    resp = [F.col("request_id"), F.col("probability").cast("double"), F.col("threshold_decision"), F.col("status")]
    fields = [F.col(f.name).cast(LOG_TYPES[f.kind]).alias(f.name) for f in REQUEST_FIELDS]
    return scored.where(F.size("reasons") == 0).select(*meta, *resp, *fields)


def request_log(scored: DataFrame) -> DataFrame:
    """P25: the prediction-requests table (metadata + request fields)."""
    meta = [F.col(n).alias(n) for n, _ in METADATA_COLUMNS]
    fields = [F.col(f.name).cast(LOG_TYPES[f.kind]).alias(f.name) for f in REQUEST_FIELDS]
    return scored.where(F.size("reasons") == 0).select(*meta, *fields)


def dead_letters(scored: DataFrame) -> DataFrame:
    """ST4: rejected messages with their raw value and reasons."""
    return scored.where(F.size("reasons") > 0).select("event_id", "key", "value", "topic", "partition", "offset",
                                                      "reasons")


# --- monitoring-side payloads (P22, P23, D9, F7, F9) ---------------------------------------

def payload_columns(decoded: DataFrame, names: Sequence[str], application: str = "application") -> DataFrame:
    """The application's raw text per field (absent key → NULL), as an analysis table would hold it."""
    opened = decoded.select("key", F.try_variant_get(F.col(application), "$", _members(names, "string")).alias("__p"))
    return opened.select("key", *[F.col(f"__p.{n}").alias(n) for n in names])


def evaluator_payload(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """P22 + P23: build the evaluator payload and its validity per row.

    Per allowed field: the row value, where NULL or '' falls back to
    ``defaults`` then to the fixed fallbacks; then int/float casts (an int
    cast of text truncates floats written as numbers but rejects other text).
    Adds ``payload_valid``, ``missing_fields`` (required fields NULL/'' in
    the raw row) and ``api_accepts``: whether the scoring service's own id
    rule (P8 in P24) takes the payload. The fallback of a missing client id
    is a text, so such a payload is built but rejected when it is sent.
    """
    defaults = defaults or {}
    allowed = list(API_REQUIRED_FIELDS) + list(API_OPTIONAL_FIELDS)
    cols, bad, refused = [], [], F.lit(False)
    for name in allowed:
        raw = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        empty = raw.isNull() | (raw == "")
        v = raw
        if name in defaults:
            v = F.when(empty, F.lit(default_text(defaults[name]))).otherwise(v)
        if name in REQUIRED_FALLBACKS:
            v = F.when(v.isNull() | (v == ""), F.lit(default_text(REQUIRED_FALLBACKS[name]))).otherwise(v)
        if name in API_INT_FIELDS:
            d = v.try_cast("double")
            ok = v.isNull() | (d.isNotNull() & F.trim(v).rlike(r"^[+-]?[0-9]+$")) | (
                d.isNotNull() & F.lit(name in df.columns and _numeric(df, name)))
            n = F.when(ok, d).try_cast("int")
            cols.append(n.alias(name))
            bad.append(~ok | (v.isNotNull() & n.isNull()))
        elif name in API_FLOAT_FIELDS:
            d = v.try_cast("double")
            ok = v.isNull() | d.isNotNull()
            cols.append(d.alias(name))
            bad.append(~ok)
        else:
            cols.append(v.alias(name))
        if name in ID_FIELDS:
            refused = refused | id_error(v).isNotNull()
    invalid = F.lit(False)
    for b in bad:
        invalid = invalid | b
    missing = F.array_compact(F.array(*[
        F.when((F.col(n).isNull() | (F.col(n).cast("string") == "")) if n in df.columns else F.lit(True), F.lit(n))
        for n in API_REQUIRED_FIELDS
    ]))
    out = F.struct(F.struct(*cols).alias("api_payload"), (~invalid).alias("payload_valid"), (~refused).alias("api_accepts"),
                   missing.alias("missing_fields"))
    # generator boundary: filters on payload_valid do not re-inline the validation
    return df.select("*", F.inline(F.array(out)))


def _numeric(df: DataFrame, name: str) -> bool:
    from pyspark.sql.types import NumericType

    return isinstance(df.schema[name].dataType, NumericType)


def scoring_accounting(payloads: DataFrame) -> DataFrame:
    """Rows scored, rows dropped, and how many of these only the scoring service rejected."""
    sent, taken = F.col("payload_valid"), F.col("payload_valid") & F.col("api_accepts")
    return payloads.agg(
        F.count_if(taken).alias("scored"),
        F.count_if(~taken).alias("dropped"),
        F.count_if(sent & ~F.col("api_accepts")).alias("api_rejected"),
    )


def top_missing_fields(payloads: DataFrame, k: int = 8) -> DataFrame:
    """the ``k`` required fields most often missing among dropped rows (ties by name)."""
    return (
        payloads.where(~F.col("payload_valid"))
        .select(F.explode("missing_fields").alias("field"))
        .groupBy("field").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("field")).limit(k)
    )


def split_valid(scored: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the reasons array."""
    return scored.where(F.size(reasons) == 0), scored.where(F.size(reasons) > 0)


def field_names(kind: str | None = None) -> Sequence[str]:
    return [f.name for f in REQUEST_FIELDS if kind is None or f.kind == kind]
