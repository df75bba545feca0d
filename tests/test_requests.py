"""J1, P21, P24, P30 and the evaluator payload on FIXTURES.md §2 payload_values."""

import json

from pyspark.sql import functions as F

from lendwise.operators import requests as R

APP = {"id_cliente": 7, "valor_credito": 400.0, "tipo_contrato": "Cash loans"}


def _msgs(spark, values):
    rows = [(str(i) if i != 9 else None, v, "predict", 0, i, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint, "
                                       "timestamp timestamp_ntz")


def test_envelopes_and_rejections(spark):
    values = [
        json.dumps({"payload": APP}),
        json.dumps({"application": APP}),
        json.dumps({"data": APP}),
        json.dumps({"body": APP}),
        json.dumps(APP),
        json.dumps({"payload": "text", "body": APP}),          # envelope key holding a string
        json.dumps({"data": APP, "payload": dict(APP, id_cliente=8)}),  # two envelopes: payload wins
        "[1, 2]",
        "5",
        "{bad json",
        None,
    ]
    d = R.decode_envelope(_msgs(spark, values)).select("offset", "envelope", "decode_error", "payload").orderBy("offset")
    rows = d.collect()
    assert [r["envelope"] for r in rows[:7]] == ["payload", "application", "data", "body", "bare", "body", "payload"]
    assert json.loads(rows[6]["payload"])["id_cliente"] == 8
    assert [r["decode_error"] for r in rows[7:]] == ["value must be a JSON object"] * 2 + ["invalid JSON", "empty value"]
    assert all(r["payload"] is None for r in rows[7:])


def test_absent_vs_explicit_null_and_defaults(spark):
    values = [
        json.dumps({"valor_credito": 10.0}),                                   # all defaults
        json.dumps({"valor_credito": 10.0, "renda_anual": None, "qtd_filhos": None, "id_cliente": None}),
        json.dumps({"valor_credito": 10.0, "data_decisao": ""}),
        json.dumps({"valor_credito": 10.0, "tipo_contrato": None}),              # required text null
        json.dumps({"valor_credito": "abc", "hora_solicitacao": 12.5}),        # bad float, fractional int
        json.dumps({"valor_credito": 10.0, "hora_solicitacao": 13.0, "id_contrato": " 27 "}),
        json.dumps({"valor_credito": 10.0, "id_cliente": "x1"}),
    ]
    n = R.normalise(R.decode_envelope(_msgs(spark, values)), processing_date=F.lit("2024-02-01").cast("date"))
    rows = n.orderBy("offset").collect()
    assert rows[0]["tipo_contrato"] == "Cash loans" and rows[0]["qtd_filhos"] == 0 and rows[0]["reasons"] == []
    assert rows[0]["id_cliente"] == 0 and rows[0]["id_contrato"] is None and rows[0]["data_decisao"] == "2024-01-01"
    assert rows[1]["renda_anual"] is None and rows[1]["qtd_filhos"] is None and rows[1]["id_cliente"] == 0
    assert rows[2]["data_decisao"] == "2024-02-01"
    assert rows[3]["reasons"] == ["tipo_contrato: required"]
    assert sorted(rows[4]["reasons"]) == ["hora_solicitacao: integer expected", "valor_credito: number expected"]
    assert rows[5]["hora_solicitacao"] == 13 and rows[5]["id_contrato"] == 27 and rows[5]["reasons"] == []
    assert rows[6]["reasons"] == ["id_cliente: numeric id expected"]


def test_scoring_log_and_ids(spark):
    values = [json.dumps({"valor_credito": v}) for v in (100.0, 200.0, 400.0)] + ["oops"]
    msgs = _msgs(spark, values)
    scored = R.score_requests(R.normalise(R.decode_envelope(msgs)), event_ts=F.current_timestamp())
    ev = {r["request_id"]: r for r in R.event_log(scored).collect()}
    assert {k: (v["probability"], v["threshold_decision"]) for k, v in ev.items()} == {
        "0": (0.2, "Aprovado"), "1": (0.4, "Revisão Manual"), "2": (0.8, "Negado")}
    dead = R.dead_letters(scored).collect()
    assert len(dead) == 1 and dead[0]["reasons"] == ["invalid JSON"]
    assert R.event_log(scored).columns[:8] == ["event_id", "event_ts", "model_name", "model_stage", "request_id",
                                               "probability", "threshold_decision", "status"]
    assert R.request_log(scored).count() == 3


def test_request_id_fallback_is_stable(spark):
    msgs = _msgs(spark, ["{}"] * 10)
    ids = [r[0] for r in msgs.select(R.request_ids(msgs)).collect()]
    assert ids[9] != "9" and len(ids[9]) == 64
    assert ids[9] == [r[0] for r in msgs.select(R.request_ids(msgs)).collect()][9]


def test_evaluator_payload_policy(spark):
    df = spark.createDataFrame([("5", "", "12"), ("6", "2024-01-01", "doze"), (None, None, "3.5")],
                               "id_cliente string, data_decisao string, hora_solicitacao string")
    p = R.evaluator_payload(df).collect()
    assert [r["payload_valid"] for r in p] == [True, False, False]
    assert p[0]["api_payload"]["data_decisao"] == "2024-01-01" and p[0]["api_payload"]["hora_solicitacao"] == 12
    assert "id_cliente" in p[2]["missing_fields"] and "tipo_contrato" in p[2]["missing_fields"]
    acc = R.scoring_accounting(R.evaluator_payload(df)).first()
    assert (acc["scored"], acc["dropped"]) == (1, 2)
    top = R.top_missing_fields(R.evaluator_payload(df), 8).collect()
    assert len(top) == 8 and top[0]["count"] == 2


def test_evaluator_defaults_before_fallbacks(spark):
    df = spark.createDataFrame([("5", "", None)], "id_cliente string, canal_venda string, valor_bem string")
    p = R.evaluator_payload(df, defaults={"canal_venda": "loja", "valor_bem": 10.5}).first()["api_payload"]
    assert p["canal_venda"] == "loja" and p["valor_bem"] == 10.5   # env-style defaults win over fallbacks
    q = R.evaluator_payload(df).first()["api_payload"]
    assert q["canal_venda"] == "online" and q["valor_bem"] == 0.0   # fixed fallbacks otherwise


def _normalised(spark, values):
    n = R.normalise(R.decode_envelope(_msgs(spark, values)), processing_date=F.lit("2024-02-01").cast("date"))
    return n.orderBy("offset").collect()


def test_integer_out_of_range_is_a_rejection(spark):
    bad, good = _normalised(spark, [json.dumps(dict(APP, qtd_parcelas_planejadas=99999999999)),
                                    json.dumps(dict(APP, qtd_parcelas_planejadas=12))])
    assert bad["reasons"] == ["qtd_parcelas_planejadas: integer expected"] and bad["qtd_parcelas_planejadas"] is None
    assert good["reasons"] == [] and good["qtd_parcelas_planejadas"] == 12
    df = spark.createDataFrame([("99999999999",), ("12",)], "qtd_parcelas_planejadas string")
    assert [r["payload_valid"] for r in R.evaluator_payload(df).collect()] == [False, True]


def test_nan_is_no_amount(spark):
    (row,) = _normalised(spark, [json.dumps(dict(APP, valor_credito="NaN"))])
    assert row["reasons"] == ["valor_credito: number expected"]


def test_last_of_repeated_keys_counts(spark):
    (row,) = _normalised(spark, ['{"id_cliente": 1, "valor_credito": 5.0, "id_cliente": 2}'])
    assert row["reasons"] == [] and row["id_cliente"] == 2


def test_hand_written_expectations_for_bad_messages(spark):
    got = _normalised(spark, [
        "{bad json", None, "[1]", "{}", '{"id_cliente": null}', '{"id_cliente": true}', '{"id_cliente": " "}',
        '{"id_cliente": 1.5}', '{"tipo_contrato": null}',
    ])
    assert [r["reasons"] for r in got] == [
        ["invalid JSON"], ["empty value"], ["value must be a JSON object"], [], [],
        ["id_cliente: numeric id expected"], [], ["id_cliente: numeric id expected"], ["tipo_contrato: required"],
    ]
    assert [got[i]["id_cliente"] for i in (3, 4, 6)] == [0, 0, 0]


def test_only_strings_are_text(spark):
    got = _normalised(spark, [
        json.dumps(dict(APP, tipo_contrato=123)), json.dumps(dict(APP, tipo_contrato={"a": "x"}, sexo=True)),
        json.dumps(dict(APP, tipo_contrato=["x"], faixa_rendimento=1.5)), json.dumps(dict(APP, tipo_contrato="123", sexo=None)),
        json.dumps(dict(APP, valor_credito={"v": 1})), json.dumps(dict(APP, valor_credito="12.5", hora_solicitacao="7")),
        json.dumps(dict(APP, id_cliente=[7])), json.dumps({"payload": dict(APP, canal_venda=0)}),
    ])
    assert [sorted(r["reasons"]) for r in got] == [
        ["tipo_contrato: text expected"], ["sexo: text expected", "tipo_contrato: text expected"],
        ["faixa_rendimento: text expected", "tipo_contrato: text expected"], [],
        ["valor_credito: number expected"], [], ["id_cliente: numeric id expected"], ["canal_venda: text expected"],
    ]
    assert got[0]["tipo_contrato"] is None and got[3]["tipo_contrato"] == "123" and got[3]["sexo"] is None
    assert got[5]["valor_credito"] == 12.5 and got[5]["hora_solicitacao"] == 7


def test_messages_are_parsed_once(spark):
    n = R.normalise(R.decode_envelope(_msgs(spark, [json.dumps(APP)])))
    plan = n.select("reasons", "tipo_contrato")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "from_json" not in plan.lower() and "to_json" not in plan.lower()


def test_payloads_that_only_the_service_rejects(spark):
    """A missing client id falls back to a text: the payload is built, sent and refused."""
    df = spark.createDataFrame([("5", None), (None, None), ("", "3"), ("7", "x"), ("8", " 9 ")], "id_cliente string, id_contrato string")
    got = R.evaluator_payload(df)
    assert [(r["payload_valid"], r["api_accepts"]) for r in got.collect()] == [
        (True, True), (True, False), (True, False), (True, False), (True, True)]
    assert R.scoring_accounting(got).first().asDict() == {"scored": 2, "dropped": 3, "api_rejected": 3}
    assert R.top_missing_fields(got).count() == 0  # fields are counted where no payload could be built
