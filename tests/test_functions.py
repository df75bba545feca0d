"""Scalar expressions (P1–P20, P8) on FIXTURES.md §2 edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from lendwise.functions import features as X
from lendwise.functions.dates import age_floor_days, calendar_age, lenient_date, year_difference
from lendwise.functions.decisions import decision_band, rounded_probability
from lendwise.functions.ids import id_error, id_value


def test_profile_edges(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 2, "Y", dt.date(2000, 2, 29)), (2, None, 0, "N", dt.date(1990, 1, 1)),
         (3, 120000.0, 3, "x", dt.date(1990, 6, 15)), (4, 60000.0, 1, None, dt.date(1990, 6, 16))],
        "id_cliente bigint, renda_anual double, qtd_membros_familia int, possui_carro string, data_nascimento date")
    ref = F.lit("2024-06-15").cast("date")
    rows = {r["id_cliente"]: r for r in df.select(
        "id_cliente",
        X.yes_no_flag("possui_carro").alias("flag"),
        X.yes_no_flag("possui_carro", other=0).alias("flag0"),
        X.income_per_member().alias("pc"),
        X.instalment_to_income(F.lit(1000.0), "renda_anual").alias("dti"),
        calendar_age("data_nascimento", ref).alias("age"),
        year_difference("data_nascimento", ref).alias("age_y"),
    ).collect()}
    assert (rows[1]["flag"], rows[3]["flag"], rows[4]["flag"]) == (1, None, None)
    assert (rows[3]["flag0"], rows[4]["flag0"]) == (0, 0)
    assert rows[1]["pc"] == 0.0 and rows[2]["pc"] is None and rows[3]["pc"] == 40000.0
    assert rows[1]["dti"] is None and rows[2]["dti"] is None and rows[3]["dti"] == 0.1
    assert rows[3]["age"] == 34 and rows[4]["age"] == 33 and rows[4]["age_y"] == 34
    assert rows[1]["age"] == 24


def test_contract_edges(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 0.0, 6), (2, 100.0, None, 7), (3, 0.0, 0.0, 21), (4, 100.0, 200.0, 22), (5, 100.0, 50.0, None)],
        "id_contrato bigint, valor_credito double, valor_bem double, hora_solicitacao int")
    rows = {r["id_contrato"]: r for r in df.select(
        "id_contrato", X.loan_to_value().alias("ltv"), X.risk_hour_flag().alias("h")).collect()}
    assert rows[1]["ltv"] == 1.0 and rows[2]["ltv"] == 1.0 and rows[3]["ltv"] is None and rows[4]["ltv"] == 0.5
    assert [rows[i]["h"] for i in range(1, 6)] == [1, 0, 0, 1, 0]


def test_negative_age_floors(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), dt.date(2000, 1, 11))], "decisao date, nasc date")
    assert df.select(age_floor_days("decisao", "nasc")).first()[0] == -1


def test_lenient_date(spark):
    df = spark.createDataFrame([("2024-01-31",), ("bad",), (None,)], "s string")
    assert [r[0] for r in df.select(lenient_date("s")).collect()] == [dt.date(2024, 1, 31), None, None]


def test_decision_bands_match_reference_examples(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.8,), (0.3,), (0.5,), (0.30001,), (0.50001,), (None,)], "p double")
    got = [r[0] for r in df.select(decision_band("p")).collect()]
    assert got == ["Aprovado", "Revisão Manual", "Negado", "Aprovado", "Revisão Manual", "Revisão Manual",
                   "Negado", None]
    assert spark.createDataFrame([(0.12345,)], "p double").select(rounded_probability("p")).first()[0] == 0.1235


def test_id_values(spark):
    vals = ["", "  ", "27", " 27 ", "-3", "12.0", "12.5", "abc", "true", None]
    df = spark.createDataFrame([(v,) for v in vals], "raw string")
    rows = df.select(id_value("raw", 0).alias("v"), id_error("raw").alias("e")).collect()
    assert [r["v"] for r in rows] == [0, 0, 27, 27, -3, None, None, None, None, 0]
    assert [r["e"] is None for r in rows] == [True, True, True, True, True, False, False, False, False, True]


def test_strict_date_raises_under_ansi(spark):
    import pytest

    from lendwise.functions.dates import strict_date

    ok = spark.createDataFrame([("2024-01-31",)], "s string").select(strict_date("s")).first()[0]
    assert ok == dt.date(2024, 1, 31)
    with pytest.raises(Exception):
        spark.createDataFrame([("31/01/2024",)], "s string").select(strict_date("s")).collect()
