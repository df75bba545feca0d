"""Bindings of the lending tables onto the shipped test tables.

The lending tables themselves are not shipped; these views derive them from
the TPC-H-like tables so every operator runs over whole tables whose size
grows with the scale factor. Each binding exists twice: as a Spark
DataFrame builder and as DuckDB SQL (``ORACLE_VIEWS``) used by the oracle
check. Both spell out the same arithmetic, with explicit DOUBLE literals so
no engine falls back to decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    from lendwise.sources.readers import read_parquet

    return read_parquet(spark, f"{sf_dir}/{name}.parquet", spread=spread)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """historico_emprestimos ← orders (one row per contract)."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return _read(spark, sf_dir, "orders").select(
        k.alias("id_contrato"),
        F.col("o_custkey").alias("id_cliente"),
        F.to_date("o_orderdate").alias("data_decisao"),
        F.col("o_orderpriority").alias("tipo_contrato"),
        F.col("o_orderstatus").alias("status_contrato"),
        price.alias("valor_credito"),
        (price * (F.lit(0.8) + (k % 5).cast("double") * F.lit(0.1))).alias("valor_solicitado"),
        F.when(k % 10 == 0, F.lit(0.0))
        .when(k % 10 == 1, F.lit(None).cast("double"))
        .otherwise(price * F.lit(1.1))
        .alias("valor_bem"),
        (price / F.lit(24.0)).alias("valor_parcela"),
        (k % 24).cast("int").alias("hora_solicitacao"),
    )


def instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """historico_parcelas ← lineitem ⋈ orders (contract × instalment, may repeat).

    Both sides are dealt by contract over a number of tasks that grows with
    ``lineitem``, so what a task sorts and groups stays the same at any size;
    grouping by contract needs no further exchange.
    """
    from lendwise.sources.readers import tasks_by_size

    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice"
    )
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = tasks_by_size(li)
    j = li.repartition(parts, "l_orderkey").join(od.repartition(parts, "o_orderkey"), li.l_orderkey == od.o_orderkey, "inner")
    due = F.date_add(F.to_date("o_orderdate"), F.col("l_linenumber") * 30)
    shift = (F.col("l_partkey") % 90).cast("int") - F.lit(45)
    unpaid = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return j.select(
        F.col("l_orderkey").alias("id_contrato"),
        F.col("o_custkey").alias("id_cliente"),
        F.col("l_linenumber").alias("numero_parcela"),
        due.alias("data_prevista_pagamento"),
        F.when(unpaid, F.lit(None).cast("date")).otherwise(F.date_add(due, shift)).alias("data_real_pagamento"),
        F.col("l_extendedprice").alias("valor_pago"),
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base_cadastral ← customer (one row per client)."""
    ck = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        ck.alias("id_cliente"),
        F.col("c_mktsegment").alias("tipo_renda"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
        .otherwise(F.col("c_acctbal") * F.lit(20.0))
        .alias("renda_anual"),
        (F.col("c_nationkey") % 6).cast("int").alias("qtd_membros_familia"),
        F.when(ck % 3 == 0, F.lit("Y")).when(ck % 3 == 1, F.lit("N")).alias("possui_carro"),
        F.date_add(F.lit("1950-01-01").cast("date"), ((ck * 17) % 18000).cast("int")).alias("data_nascimento"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base_submissao ← events (client repeats; ``ts`` orders "latest")."""
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("id_cliente"),
        F.col("ts").alias("data_solicitacao"),
        F.col("event_type").alias("tipo_contrato"),
        F.col("value").alias("valor_credito"),
        F.col("event_id"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prediction_events ← events (``value/500`` capped at 1 is the probability)."""
    return _read(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("ts").alias("event_ts"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("probability"),
        F.col("event_type"),
        (F.col("event_type") == "purchase").cast("int").alias("target"),
        F.col("user_id").alias("id_cliente"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score ← labels ⋈ documents (``n_chars`` is the score)."""
    lab = _read(spark, sf_dir, "labels")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return lab.join(docs, "doc_id", "inner").select(
        "doc_id",
        "quality",
        "toxic",
        F.col("n_chars").cast("double").alias("score"),
        "source",
        "lang",
    )


# Request envelope chosen by event_id % 5 (fixed binding, see FIXTURES.md §1).


def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kafka-shaped request messages ← events: ``key`` = event_id text, ``value`` = JSON.

    The application object carries client id, amount, type, decision date
    (empty when ``event_id % 7 = 0``), the hour and the planned term as text
    (non-numeric when ``user_id % 13 = 0``); ``event_id % 5`` picks the
    envelope (payload / application / data / body / bare). ``event_id % 101``
    below 14 makes a faulty message: no JSON, NULL, an array, a scalar, a
    second envelope key that holds text, a NULL, numeric, nested or absent
    member, an integer out of range or with a fraction, a NULL id, a missing
    message key, a flag for an amount.
    """
    ev = _read(spark, sf_dir, "events", spread=True)  # JSON decoding downstream is CPU-bound
    uid = F.col("user_id")
    app = F.struct(
        uid.alias("id_cliente"),
        F.col("event_type").alias("tipo_contrato"),
        F.col("value").alias("valor_credito"),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd")).alias("data_decisao"),
        F.hour(F.col("ts")).alias("hora_solicitacao"),
        F.when(uid % 13 == 0, F.lit("doze")).otherwise((uid % 13 + 1).cast("string")).alias("qtd_parcelas_planejadas"),
    )
    fault = F.col("event_id") % 101
    kind, hour = F.concat(F.lit('"tipo_contrato":"'), F.col("event_type"), F.lit('"')), F.concat(F.lit('"hora_solicitacao":'), F.hour("ts"))
    client = F.concat(F.lit('"id_cliente":'), uid)
    # The JSON text and the body are columns of their own: written out in each branch, they would be planned dozens of times.
    plain, body = F.col("__plain"), F.col("__body")

    def swapped(text: Column, old: Column, new: str) -> Column:
        return F.replace(text, old, F.lit(new))

    faulty = (
        F.when(fault == 5, swapped(plain, kind, '"tipo_contrato":null'))
        .when(fault == 6, swapped(plain, kind, '"tipo_contrato":123'))
        .when(fault == 7, swapped(plain, kind, '"tipo_contrato":{"a":"b"}'))
        .when(fault == 8, swapped(plain, F.concat(kind, F.lit(",")), ""))
        .when(fault == 9, swapped(plain, hour, '"hora_solicitacao":99999999999'))
        .when(fault == 10, swapped(plain, hour, '"hora_solicitacao":12.5'))
        .when(fault == 11, swapped(plain, client, '"id_cliente":null'))
        .when(fault == 13, swapped(plain, F.lit('"valor_credito":'), '"valor_bem":true,"valor_credito":'))
        .otherwise(plain)
    )
    told = ev.select("event_id", "ts", "user_id", "event_type", F.to_json(app).alias("__plain"))
    told = told.select("event_id", "ts", faulty.alias("__body"))
    m = F.col("event_id") % 5
    value = (
        F.when(m == 0, F.concat(F.lit('{"payload":'), body, F.lit("}")))
        .when(m == 1, F.concat(F.lit('{"application":'), body, F.lit("}")))
        .when(m == 2, F.concat(F.lit('{"data":'), body, F.lit("}")))
        .when(m == 3, F.concat(F.lit('{"body":'), body, F.lit("}")))
        .otherwise(body)
    )
    value = (
        F.when(fault == 0, F.lit("{bad json")).when(fault == 1, F.lit(None).cast("string"))
        .when(fault == 2, F.lit("[1, 2]")).when(fault == 3, F.lit("5"))
        .when(fault == 4, F.concat(F.lit('{"payload":"text","body":'), body, F.lit("}")))
        .otherwise(value)
    )
    return told.select(
        F.when(fault != 12, F.col("event_id").cast("string")).alias("key"),
        value.alias("value"),
        F.lit("predict").alias("topic"),
        (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )


# DuckDB views of the same bindings, for the oracle SQL (tables are the
# driver's pre-registered views over the same parquet files).
ORACLE_VIEWS: dict[str, str] = {
    "contracts": """
        SELECT o_orderkey AS id_contrato, o_custkey AS id_cliente,
               CAST(o_orderdate AS DATE) AS data_decisao,
               o_orderpriority AS tipo_contrato, o_orderstatus AS status_contrato,
               o_totalprice AS valor_credito,
               o_totalprice * (0.8::DOUBLE + CAST(o_orderkey % 5 AS DOUBLE) * 0.1::DOUBLE) AS valor_solicitado,
               CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE
                    WHEN o_orderkey % 10 = 1 THEN NULL::DOUBLE
                    ELSE o_totalprice * 1.1::DOUBLE END AS valor_bem,
               o_totalprice / 24.0::DOUBLE AS valor_parcela,
               CAST(o_orderkey % 24 AS INTEGER) AS hora_solicitacao
        FROM orders""",
    "instalments": """
        SELECT l.l_orderkey AS id_contrato, o.o_custkey AS id_cliente,
               l.l_linenumber AS numero_parcela,
               CAST(o.o_orderdate AS DATE) + CAST(30 * l.l_linenumber AS INTEGER) AS data_prevista_pagamento,
               CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN NULL::DATE
                    ELSE CAST(o.o_orderdate AS DATE) + CAST(30 * l.l_linenumber AS INTEGER)
                         + (CAST(l.l_partkey % 90 AS INTEGER) - 45) END AS data_real_pagamento,
               l.l_extendedprice AS valor_pago
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "profile": """
        SELECT c_custkey AS id_cliente, c_mktsegment AS tipo_renda,
               CASE WHEN c_acctbal < 0 THEN NULL::DOUBLE ELSE c_acctbal * 20.0::DOUBLE END AS renda_anual,
               CAST(c_nationkey % 6 AS INTEGER) AS qtd_membros_familia,
               CASE WHEN c_custkey % 3 = 0 THEN 'Y' WHEN c_custkey % 3 = 1 THEN 'N' END AS possui_carro,
               DATE '1950-01-01' + CAST((c_custkey * 17) % 18000 AS INTEGER) AS data_nascimento
        FROM customer""",
    "applications": """
        SELECT user_id AS id_cliente, ts AS data_solicitacao, event_type AS tipo_contrato,
               value AS valor_credito, event_id
        FROM events""",
    "predictions": """
        SELECT event_id, ts AS event_ts, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS probability,
               event_type, CAST(event_type = 'purchase' AS INTEGER) AS target, user_id AS id_cliente
        FROM events""",
    "scored_labels": """
        SELECT l.doc_id, l.quality, l.toxic, CAST(d.n_chars AS DOUBLE) AS score, d.source, d.lang
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "request_messages": """
        SELECT CASE WHEN fault <> 12 THEN CAST(event_id AS VARCHAR) END AS key,
               CASE WHEN fault = 0 THEN '{bad json' WHEN fault = 1 THEN NULL WHEN fault = 2 THEN '[1, 2]' WHEN fault = 3 THEN '5'
                    WHEN fault = 4 THEN '{"payload":"text","body":' || body || '}'
                    WHEN event_id % 5 = 0 THEN '{"payload":' || body || '}'
                    WHEN event_id % 5 = 1 THEN '{"application":' || body || '}'
                    WHEN event_id % 5 = 2 THEN '{"data":' || body || '}'
                    WHEN event_id % 5 = 3 THEN '{"body":' || body || '}'
                    ELSE body END AS value,
               'predict' AS topic, CAST(event_id % 4 AS INTEGER) AS "partition",
               event_id AS "offset", ts AS "timestamp"
        FROM (SELECT *, CASE fault
                 WHEN 5 THEN replace(plain, '"tipo_contrato":"' || event_type || '"', '"tipo_contrato":null')
                 WHEN 6 THEN replace(plain, '"tipo_contrato":"' || event_type || '"', '"tipo_contrato":123')
                 WHEN 7 THEN replace(plain, '"tipo_contrato":"' || event_type || '"', '"tipo_contrato":{"a":"b"}')
                 WHEN 8 THEN replace(plain, '"tipo_contrato":"' || event_type || '",', '')
                 WHEN 9 THEN replace(plain, '"hora_solicitacao":' || hour(ts), '"hora_solicitacao":99999999999')
                 WHEN 10 THEN replace(plain, '"hora_solicitacao":' || hour(ts), '"hora_solicitacao":12.5')
                 WHEN 11 THEN replace(plain, '"id_cliente":' || user_id, '"id_cliente":null')
                 WHEN 13 THEN replace(plain, '"valor_credito":', '"valor_bem":true,"valor_credito":')
                 ELSE plain END AS body
          FROM (SELECT *, event_id % 101 AS fault, CAST(to_json({'id_cliente': user_id, 'tipo_contrato': event_type,
                                      'valor_credito': value,
                                      'data_decisao': CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END,
                                      'hora_solicitacao': hour(ts),
                                      'qtd_parcelas_planejadas': CASE WHEN user_id % 13 = 0 THEN 'doze'
                                                                 ELSE CAST(user_id % 13 + 1 AS VARCHAR) END}) AS VARCHAR) AS plain
              FROM events))""",
}


def with_views(sql: str, *names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with a WITH clause: the named oracle views, then ``ctes``."""
    if sql.lstrip().upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    parts = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in (ctes or [])]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql


# Reference / analysis split of the event stream for monitoring (fixed cut: mid-month).
DRIFT_CUT = "2024-01-16 00:00:00"


def monitoring_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, analysis): events before / from the cut, with model features and score."""
    ev = _read(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("event_ts"),
        F.col("value"),
        F.col("event_type"),
        F.hour("ts").alias("hora"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("probability"),
        (F.col("event_type") == "purchase").cast("int").alias("target"),
    )
    cut = F.lit(DRIFT_CUT).cast("timestamp_ntz")
    return ev.where(F.col("event_ts") < cut), ev.where(F.col("event_ts") >= cut)


ORACLE_VIEWS["monitoring"] = """
        SELECT event_id, ts AS event_ts, value, event_type, CAST(hour(ts) AS INTEGER) AS hora,
               least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS probability,
               CAST(event_type = 'purchase' AS INTEGER) AS target,
               ts < TIMESTAMP '2024-01-16 00:00:00' AS is_reference
        FROM events"""
