"""M1, M2, M3, D1, JN2–JN4, JN6 on application_edges / contract_edges fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from lendwise.functions.columns import align_columns, common_feature_columns, drop_columns, rename_collisions
from lendwise.operators.dedup import keep_first, keep_last
from lendwise.plans import assemble as A


def _tables(spark):
    contracts = spark.createDataFrame(
        [(1, 10, "Cash", "A", 100.0, 0.0, 10.0, 6, dt.date(2020, 1, 1)),
         (2, 20, "POS", "B", 50.0, 25.0, 5.0, 22, dt.date(2020, 1, 1)),
         (3, 99, "Cash", None, 10.0, None, 1.0, None, dt.date(1980, 1, 1))],   # unknown client
        "id_contrato bigint, id_cliente bigint, tipo_contrato string, status_contrato string, valor_credito double, "
        "valor_bem double, valor_parcela double, hora_solicitacao int, data_decisao date")
    inst = spark.createDataFrame(
        [(1, 1, "2020-02-01", None), (2, 1, "2020-02-01", "2020-02-01"), (3, 1, "2020-02-01", "2020-02-05"),
         (4, 1, "2020-02-01", None)],  # contract 4 has no contract row
        "id_contrato bigint, numero_parcela int, data_prevista_pagamento string, data_real_pagamento string")
    profile = spark.createDataFrame(
        [(10, 120000.0, 2, "Y", dt.date(1990, 1, 1)), (20, 0.0, 0, None, dt.date(2000, 6, 1))],
        "id_cliente bigint, renda_anual double, qtd_membros_familia int, possui_carro string, data_nascimento date")
    apps = spark.createDataFrame(
        [(10, dt.datetime(2020, 1, 1), "Cash", 1.0, 1), (10, dt.datetime(2020, 1, 3), "POS", 2.0, 2),
         (10, dt.datetime(2020, 1, 3), "Revolving", 3.0, 3),  # tie on time → larger event_id wins
         (77, dt.datetime(2020, 1, 1), "Cash", 9.0, 4)],      # client absent elsewhere
        "id_cliente bigint, data_solicitacao timestamp, tipo_contrato string, valor_credito double, event_id bigint")
    return contracts, inst, profile, apps


def test_training_set(spark):
    c, i, p, a = _tables(spark)
    ts = {r["id_contrato"]: r for r in A.training_set(c, i, p, a, application_order=["data_solicitacao", "event_id"]).collect()}
    assert sorted(ts) == [1, 2, 3]
    assert ts[1]["tipo_contrato_submissao"] == "Revolving" and ts[1]["valor_credito_submissao"] == 3.0
    assert ts[2]["tipo_contrato_submissao"] is None and ts[3]["renda_anual"] is None
    assert (ts[1]["target_fpd"], ts[2]["target_fpd"], ts[3]["target_fpd"]) == (1, 0, 1)


def test_feature_block(spark):
    c, i, p, _ = _tables(spark)
    nb = A.notebook_training_set(c, i, p)
    f = {r["valor_credito"]: r for r in A.credit_features(nb).collect()}
    assert "id_contrato" not in A.credit_features(nb).columns and "renda_anual" not in A.credit_features(nb).columns
    assert f[100.0]["feat_ltv"] == 1.0 and f[50.0]["feat_ltv"] == 2.0
    assert f[100.0]["feat_hora_pico_fraude"] == 1 and f[10.0]["feat_hora_pico_fraude"] == 0
    assert f[100.0]["feat_idade"] == 30 and f[10.0]["feat_idade"] is None
    assert (f[100.0]["feat_status_contrato_enc"], f[50.0]["feat_status_contrato_enc"],
            f[10.0]["feat_status_contrato_enc"]) == (0.0, 1.0, 2.0)  # A, B, Missing
    kept = A.credit_features(nb, keep_profile_features=True)
    assert "feat_renda_per_capita" in kept.columns
    aligned = A.credit_features(nb, feature_names=["feat_ltv", "nope"])
    assert aligned.columns == ["feat_ltv", "nope"]


def test_merge_lending_tables(spark):
    c, i, p, a = _tables(spark)
    m = A.merge_lending_tables(c, p, None, i.withColumn("valor_pago", i["numero_parcela"] * 2.0))
    r = {x["id_contrato"]: x for x in m.collect()}
    assert r[1]["valor_pago_parcelas_mean"] == 2.0 and r[1]["renda_anual"] == 120000.0
    m2 = A.merge_lending_tables(a, p, c, None)  # applications lack a contract key: contract join skipped
    assert "status_contrato" not in m2.columns and m2.count() == 4


def test_column_helpers_and_dedup(spark):
    _, _, p, a = _tables(spark)
    assert rename_collisions(a, ["tipo_contrato", "id_cliente"], "id_cliente").columns[2] == "tipo_contrato_submissao"
    assert drop_columns(p, ["renda_anual", "absent"]).columns == ["id_cliente", "qtd_membros_familia", "possui_carro",
                                                                 "data_nascimento"]
    assert align_columns(p, ["x", "id_cliente"], {"x": 7}).first()["x"] == 7
    assert common_feature_columns(p, a, ("id_cliente",)) == []
    first = {r["id_cliente"]: r["event_id"] for r in keep_first(a, "id_cliente", ["data_solicitacao", "event_id"]).collect()}
    last = {r["id_cliente"]: r["event_id"] for r in keep_last(a, "id_cliente", ["data_solicitacao", "event_id"]).collect()}
    assert first == {10: 1, 77: 4} and last == {10: 3, 77: 4}


def test_hot_client_is_dealt_over_tasks(spark):
    """Half of all rows have one client and a tenth none: same rows as the plain join, no task with more than a small part."""
    import random

    from lendwise.operators import joins as J

    rng = random.Random(4)
    rows = [(i, 0 if i % 2 else None if i % 10 == 0 else rng.randrange(1, 4000), rng.random()) for i in range(20_000)]
    left = spark.createDataFrame(rows, "id long, id_cliente long, v double")
    right = spark.createDataFrame([(c, f"n{c}", c / 2.0) for c in range(0, 4000, 3)] + [(0, "second row", 1.0)], "id_cliente long, nome string, v double")
    plain = J.left_join_if_keyed(left, right, "id_cliente")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        split = J.left_join_if_keyed(left, right, "id_cliente", split_hot=True)
        assert split.columns == plain.columns
        most = lambda df: max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert most(plain) > 20_000 and most(split) < 3_000  # the hot client's rows are two each
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(split.collect(), key=key) == sorted(plain.collect(), key=key)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    apps = right.withColumn("data_solicitacao", F.col("v"))
    a, b = (J.left_join_latest(left, apps, "id_cliente", ["data_solicitacao", "nome"], split_hot=s) for s in (False, True))
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count() == 20_000
