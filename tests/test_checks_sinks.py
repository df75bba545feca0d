"""M19, M20, D4–D8 (runs / gate_cases fixtures) and sinks S3, S8, S10, S12, S13, S16, S17."""

import os
import tempfile

import pytest

from lendwise.operators import checks as C
from lendwise.operators import drift as D
from lendwise.session import scratch_path
from lendwise.sources import readers as RD
from lendwise.sources import sinks as SK


def test_champion(spark):
    runs = spark.createDataFrame(
        [("m1", "9", "None", 0.7), ("m1", "10", "None", 0.6), ("m2", "3", "Production", None), ("m2", "5", "None", 0.9),
         ("m3", None, "None", 0.5)], "model string, version string, stage string, valid_auc double")
    got = {r["model"]: (r["champion_version"], r["champion_auc"]) for r in C.champion(runs).collect()}
    assert got == {"m1": (10, 0.6), "m2": (3, None)}


@pytest.mark.parametrize("new,champ,kw,passed", [
    (0.5, 0.9, {"disabled": True}, True),
    (0.6, None, {"min_auc": 0.7}, False),
    (0.7, None, {"min_auc": 0.7}, True),          # equality at the floor passes
    (0.6, None, {}, True),
    (0.794, 0.8, {}, False),
    (0.795, 0.8, {}, True),
    (0.8, 0.8, {"require_improvement": True}, False),
    (0.81, 0.8, {"require_improvement": True}, True),
])
def test_gate(spark, new, champ, kw, passed):
    df = spark.createDataFrame([(new, champ)], "new_auc double, champion_auc double")
    assert C.promotion_gate(df, **kw).first()["passed"] is passed


def test_checks_and_decision(spark):
    ev = spark.createDataFrame([("0.9",), ("0.05",), ("x",), (None,)], "probability string")
    d = C.denied_rate(ev).first()
    assert (d["negado_count"], d["negado_denominator"], d["negado_below_threshold_retrain"]) == (1, 2, True)
    d2 = C.denied_rate(ev, threshold=0.1, denominator_offset=10).first()
    assert d2["negado_denominator"] == 12
    with pytest.raises(RuntimeError):
        C.denied_rate(ev, prob="nope")
    drift = spark.createDataFrame([(True,), (None,), (False,)], "alert boolean")
    s = D.alert_summary(drift).first()
    assert s["alert_rate"] == 1 / 3 and s["drift_detected"] is False
    dec = C.retrain_decision(D.alert_summary(drift), C.mean_score(ev), C.denied_rate(ev)).first()
    assert dec["should_retrain"] is True


def test_suffix_dispatch_and_csv(spark):
    with pytest.raises(ValueError):
        RD.read_table(spark, "/x/data.json")
    path = scratch_path(spark, "t") + "/r.CSV"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    SK.write_csv_report(df, path, 1)
    assert sorted(tuple(r) for r in RD.read_table(spark, path, schema="k int, v string").collect()) == [(1, "a"), (2, "b")]


def test_replay_safe_append(spark):
    path = scratch_path(spark, "append")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    SK.append_batch(df, path, 0, run_id="a")
    SK.append_batch(df, path, 1, run_id="a")
    SK.append_batch(df, path, 1, run_id="a")  # replayed batch replaces itself
    assert spark.read.parquet(path).count() == 4


def test_writers_never_replace_each_other(spark):
    path, df = scratch_path(spark, "append"), spark.createDataFrame([(1,), (2,)], "k int")
    first, second = SK.run_identity(spark, scratch_path(spark, "c1")), SK.run_identity(spark, scratch_path(spark, "c2"))
    SK.append_batch(df, path, 0, run_id=first)
    SK.append_batch(df.limit(1), path, 0, run_id=second)
    SK.append_batch(df, path, 0)
    SK.append_batch(df, path, 0)  # without an identity every call appends
    assert spark.read.parquet(path).count() == 7


def test_run_identity_lasts(spark):
    folder = scratch_path(spark, "ckpt")
    assert SK.run_identity(spark, folder) == SK.run_identity(spark, folder)


def test_ddl_and_reconcile(spark):
    loc = scratch_path(spark, "tbl")
    SK.ensure_table(spark, "lw_test_db.events", [("event_id", "string"), ("p", "double")], location=loc)
    SK.ensure_table(spark, "lw_test_db.events", [("event_id", "string"), ("p", "double")], location=loc)
    added = SK.reconcile_schema(spark, "lw_test_db.events", [("event_id", "string"), ("p", "double"), ("n", "int")])
    assert added == ["n"] and "n" in spark.table("lw_test_db.events").columns
    with pytest.raises(ValueError):
        SK.reconcile_schema(spark, "lw_test_db.events", [("p", "string")])


def test_dictionary_projection(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "dic.csv"), "w") as fh:
        fh.write("coluna;descricao\n id_cliente ;x\nvalor_credito;y\n;z\n  ;w\nvalor_credito;dup\n")
    names = [r["coluna"] for r in RD.dictionary_columns(spark, os.path.join(d, "dic.csv")).collect()]
    assert sorted(names) == ["id_cliente", "valor_credito"]
    df = spark.createDataFrame([(1, 2.0, "a", 3)], "id_cliente int, valor_credito double, other string, id_contrato int")
    assert RD.project_to_columns(df, names, required=["id_contrato"]).columns == ["id_cliente", "valor_credito", "id_contrato"]


def test_prefix_source_and_input_contract(spark):
    root = scratch_path(spark, "prefix-test")
    spark.createDataFrame([(1, "a")], "id_cliente bigint, x string").write.parquet(f"{root}/base_submissao_v2.parquet")
    spark.createDataFrame([(1, 2.0)], "id_cliente bigint, renda_anual double").write.parquet(
        f"{root}/base_cadastral_v2.parquet")
    spark.createDataFrame([(1,)], "id_cliente bigint").write.parquet(f"{root}/base_cadastral_other.parquet")
    tables = RD.load_prefix_tables(spark, root, "_v2.parquet")
    assert sorted(tables) == ["base_cadastral", "base_submissao"]
    with pytest.raises(RuntimeError):
        RD.load_prefix_tables(spark, root, "_v3.parquet")
    with pytest.raises(ValueError):
        RD.require_columns(tables["base_submissao"], ["id_cliente", "id_contrato"], "base_submissao")
    with pytest.raises(ValueError):
        RD.require_non_empty(tables["base_submissao"].where("id_cliente < 0"), "base_submissao")
    assert RD.require_non_empty(tables["base_submissao"]) is tables["base_submissao"]


def test_decision_report_and_label_union(spark):
    import json

    from lendwise.operators.dedup import ordered_union_labels

    row = spark.createDataFrame([(True, False, 3, None)], "should_retrain boolean, drift_detected boolean, n int, x double")
    rep = json.loads(C.decision_report(row).first()["report"])
    assert rep == {"should_retrain": True, "drift_detected": False, "n": 3, "x": None}  # NULL kept as null
    a = spark.createDataFrame([(1,), (0,), (1,)], "y int")
    b = spark.createDataFrame([(2,), (0,)], "p int")
    assert [r["label"] for r in ordered_union_labels(a, "y", b, "p").collect()] == [0, 1, 2]


def test_champion_refuses_a_version_that_is_no_integer(spark):
    runs = spark.createDataFrame([("m", "1", "None", 0.5), ("m", "two", "None", 0.6)],
                                 "model string, version string, stage string, valid_auc double")
    with pytest.raises(Exception, match="model version is not an integer: two"):
        C.champion(runs).collect()


def test_decision_by_all_features_together_and_by_each(spark):
    """Where only the mix of two categories turns, the joint detector tells; one feature alone falls back to its distance."""
    import random

    from pyspark.sql import functions as F

    from lendwise.plans import monitor as MON

    rng = random.Random(2)

    def rows(turned, n):
        found = []
        for i in range(n):
            a = "x" if rng.random() < 0.8 else "y"
            b = ("y" if a == "x" else "x") if turned else a
            found.append((i, a, b, rng.random(), rng.randrange(2), rng.random()))
        return spark.createDataFrame(found, "event_id long, a string, b string, amount double, target int, probability double")

    ref = rows(False, 2000)
    calm, _ = MON.monitoring_decision(ref, rows(False, 1000), None, ["event_id"], chunk_size=250)
    loud, drift = MON.monitoring_decision(ref, rows(True, 1000), None, ["event_id"], chunk_size=250)
    assert not calm.first()["drift_detected"] and loud.first()["drift_detected"]
    assert "reconstruction_error" in drift.columns
    _, single = MON.monitoring_decision(ref.drop("b", "amount"), rows(True, 500).drop("b", "amount"), None, ["event_id"], chunk_size=250)
    assert "js_distance" in single.columns
    both, _ = MON.monitoring_decision(ref, ref, ref.select(F.col("probability")), ["event_id"], mean_score_check=True, multivariate=False)
    row = both.first().asDict()
    assert row["negado_denominator"] == 2000 and row["probability_above_threshold_retrain"] is True


def test_table_sink_survives_replays_and_an_interrupted_compaction(spark):
    import uuid

    from lendwise.session import scratch_path
    from lendwise.sources.sinks import TableSink

    name, where = f"sink_{uuid.uuid4().hex}", scratch_path(spark, "sink")
    df = spark.range(40).selectExpr("id", "cast(id as string) as name")
    sink = TableSink(spark, name, [("id", "bigint")], where)
    assert sink.read().count() == 0 and sink.compact() == 0
    sink.append(df.where("id < 10").select("id"), 0, "r")
    sink = TableSink(spark, name, [("id", "bigint"), ("name", "string")], where)  # a column more, nothing lost
    for batch, low in ((1, 10), (1, 10), (2, 20)):
        sink.append(df.where(f"id >= {low} and id < {low + 10}"), batch, "r")
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(30))
    assert sink.read().where("name is null").count() == 10
    # a compaction that stopped after it had written its partition and before it removed theirs
    stop = RuntimeError("stopped")

    class Stopping(TableSink):
        def _write(self, rows, part):
            super()._write(rows, part)
            if "compacted" in str(part):
                raise stop

    try:
        Stopping(spark, name, [("id", "bigint"), ("name", "string")], where).compact()
    except RuntimeError as e:
        assert e is stop
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(30))
    sink.append(df.where("id >= 20 and id < 30"), 2, "r")  # replayed after it was compacted
    sink.append(df.where("id >= 30"), 0, "other")
    assert sink.compact() >= 1 and sorted(r["id"] for r in sink.read().collect()) == list(range(40))
    parts = spark.table(name).select("part").distinct().collect()
    assert all(r["part"].startswith("compacted-") for r in parts)
    import pytest

    with pytest.raises(ValueError):
        TableSink(spark, name, [("id", "string")], where)
