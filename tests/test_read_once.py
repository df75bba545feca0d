"""Costly steps run once: the assembled frame, the scores of a model, the decoding of requests."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lendwise.plans import assemble as A
from lendwise.plans import catalog as C
from lendwise.plans import train as T


@pytest.fixture
def counted(spark):
    """A column that counts how often it is evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    return seen, F.udf(passed, "double").asNondeterministic()


def _frame(spark):
    rows = [(i, "ab"[i % 2], float(i % 7), i % 10 < 8, i % 2) for i in range(200)]
    return spark.createDataFrame(rows, "id_contrato long, tipo_contrato string, valor_credito double, is_train boolean, y int")


def _fake_score(udf):
    return lambda model, df, out="probability_1": df.withColumn(out, udf(F.col("valor_credito") / 7))


def test_model_frame_is_assembled_once(spark, counted):
    seen, udf = counted
    df = _frame(spark).drop("is_train").withColumn("tipo_contrato", F.concat("tipo_contrato", udf("valor_credito").cast("string")))
    assert T.training_frame(A.split_credit_features(df)).count() == 200
    assert seen.value == 200


def test_validation_rows_are_scored_once(spark, counted, monkeypatch):
    seen, udf = counted
    df = _frame(spark).withColumnRenamed("y", C.TARGET)
    monkeypatch.setattr(C, "_fit", lambda *a: (df, None, []))
    monkeypatch.setattr(T, "score", _fake_score(udf))
    assert len(C.gbt_validation_metrics(spark, "").collect()) == 2
    assert seen.value == 40


def test_training_run_scores_once(spark, counted, monkeypatch):
    seen, udf = counted
    ready = _frame(spark).drop("is_train")
    monkeypatch.setattr(A, "training_set", lambda *a, **k: ready)
    monkeypatch.setattr(T, "prepared_pipeline", lambda *a, **k: (SimpleNamespace(fit=lambda train: None), []))
    monkeypatch.setattr(T, "score", _fake_score(udf))
    held = T.training_run(ready, ready, target="y")[1]
    assert {r["class"] for r in held.collect()} == {0, 1}
    from lendwise.operators.encoders import hash_split

    assert seen.value == hash_split(ready, "id_contrato").where("NOT is_train").count()


def test_search_scores_a_fold_once(spark, counted):
    seen, udf = counted
    margin = F.array(F.lit(0.0), udf("valor_credito"))
    model = SimpleNamespace(getNumTrees=3, transform=lambda df: df.withColumn("rawPrediction", margin))
    real = T.vector_to_array
    try:
        T.vector_to_array = F.col
        T.prefix_aucs(model, _frame(spark), "y", [3])
    finally:
        T.vector_to_array = real
    assert seen.value == 200


def test_joined_logs_decode_each_message_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    udf = F.udf(passed, "string").asNondeterministic()
    rows = [(str(i), '{"tipo_contrato": "a", "valor_credito": %d}' % i, "predict", 0, i) for i in range(50)]
    msgs = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long") \
        .withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("value", udf("value"))
    monkeypatch.setattr(C.B, "request_messages", lambda *a: msgs)
    assert sum(r["n"] for r in C.events_join_requests(spark, "").collect()) == 50
    assert seen.value == 50
