"""What one task gets stays the same when the tables grow: tasks are dealt by the size of the input, not by a fixed number."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lendwise.operators import encoders as E
from lendwise.plans import assemble as A
from lendwise.plans import catalog as C
from lendwise.plans import train as T
from lendwise.sources import bindings as B
from lendwise.sources import readers as RD


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(2024, 1, 1)
    orders = [(i, i % 40, day, "1-URGENT", "F", 100.0 + i) for i in range(300)]
    lines = [(i % 300, i * 7 % 200, i // 300 + 1, "R" if i % 3 else "A", "O" if i % 2 else "F", 10.0 * i) for i in range(900)]
    events = [(i, i % 50, day + dt.timedelta(minutes=i), "purchase" if i % 3 else "view", float(i)) for i in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, "
                          "o_totalprice double").coalesce(1).write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, "
                          "l_extendedprice double").coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double") \
        .coalesce(1).write.parquet(f"{root}/events.parquet")
    return root


def test_instalments_are_dealt_by_the_size_of_their_files(spark, tables):
    """A session of one shuffle partition used to sort and group every instalment in one task."""
    wanted = RD.tasks_by_size(spark.read.parquet(f"{tables}/lineitem.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = B.instalments(spark, tables)
        assert wanted >= RD.TASKS_PER_SPLIT and found.rdd.getNumPartitions() == wanted
        assert found.count() == 900
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_messages_are_dealt_over_many_tasks(spark, tables):
    """One file of one row group used to be decoded by as many tasks as there are cores, or by one."""
    found = B.request_messages(spark, tables)
    assert found.rdd.getNumPartitions() >= RD.TASKS_PER_SPLIT and found.count() == 400


def test_stream_batches_hold_a_bounded_number_of_messages(spark, tables, tmp_path, monkeypatch):
    from lendwise.plans import catalog as C

    monkeypatch.setattr(C, "MESSAGES_PER_FILE", 50)
    monkeypatch.setattr(C, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = C.stream_prediction_events(spark, tables)
    whole = C.prediction_events_log(spark, tables)
    assert sorted(r["event_id"] for r in got.select("event_id").collect()) == sorted(r["event_id"] for r in whole.select("event_id").collect())
    files = [p for p in (tmp_path / "stream" / "in").iterdir() if p.suffix == ".parquet"]
    assert len(files) == 8 and all(spark.read.parquet(str(p)).count() < 100 for p in files)


def test_messages_of_a_task_are_bounded(spark, tables, monkeypatch):
    """Tasks were dealt by the splits of the scan alone, so a split of many narrow rows made long tasks."""
    monkeypatch.setattr(RD, "ROWS_PER_TASK", 4)
    found = B.request_messages(spark, tables)
    assert found.rdd.getNumPartitions() == 100 and found.count() == 400
    assert max(found.rdd.glom().map(len).collect()) <= 8


def test_the_text_of_a_message_is_planned_once(spark, tables):
    """The JSON text used to be written out in every branch of the faulty messages: dozens of copies in one projection."""
    plan = B.request_messages(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1


def _many_pieces(spark, rows=400, pieces=64):
    frame = spark.range(rows).select(
        F.col("id").alias("id_contrato"), (F.col("id") % 7).cast("double").alias("valor_credito"),
        (F.col("id") % 2).cast("int").alias(C.TARGET))
    return frame.repartition(pieces)


def test_partitions_of_a_fit():
    assert T.fit_partitions(0, 12) == 1 and T.fit_partitions(5_000, 12) == 1  # few rows: one task
    assert T.fit_partitions(100_000, 12) == 5
    assert T.fit_partitions(700_000, 12) == T.fit_partitions(12_000_000, 12) == 12
    assert T.fit_partitions(42_000_000, 12) == 48  # bounded rows of a task, whole waves
    assert T.fit_partitions(464_000, 12, 8) == 3 and T.fit_partitions(30_000_000, 12, 8) == 30


@pytest.fixture
def fitted(monkeypatch):
    """Partitions and rows of the frames that a pipeline is fitted on; nothing is fitted."""
    seen = []
    pipe = SimpleNamespace(fit=lambda train: seen.append((train.rdd.getNumPartitions(), train.count())))
    monkeypatch.setattr(T, "prepared_pipeline", lambda *a, **k: (pipe, []))
    monkeypatch.setattr(T, "score", lambda model, df, out="probability_1": df.withColumn(out, F.col("valor_credito") / 7))
    return seen


def _train_rows(spark):
    return E.hash_split(_many_pieces(spark), "id_contrato", 0.8, 42).where("is_train").count()


def test_two_waves_of_tasks_are_kept(spark):
    cores = spark.sparkContext.defaultParallelism
    kept = T.fitting_frame(T.training_frame(_many_pieces(spark, pieces=2 * cores)))
    assert kept.rdd.getNumPartitions() == 2 * cores and kept.count() == 400


def test_boosting_does_not_take_the_joins_partitions(spark, monkeypatch, fitted):
    """Every level of every tree is a job over the partitions of its input: a few rows in 64 pieces are one task."""
    monkeypatch.setattr(C, "_FITTED", {})
    monkeypatch.setattr(C, "_model_frame", lambda *a: E.hash_split(_many_pieces(spark), "id_contrato", 0.8, 42))
    C._fit(spark, "")
    assert fitted == [(1, _train_rows(spark))]


def test_training_run_does_not_take_the_joins_partitions(spark, monkeypatch, fitted):
    monkeypatch.setattr(A, "training_set", lambda *a, **k: _many_pieces(spark))
    T.training_run(None, None, target=C.TARGET)
    assert fitted == [(1, _train_rows(spark))]


def test_search_fits_on_few_partitions(spark, monkeypatch):
    fits, scored = [], []
    monkeypatch.setattr(T, "booster", lambda *a: SimpleNamespace(
        fit=lambda train: fits.append((train.rdd.getNumPartitions(), train.count()))))
    monkeypatch.setattr(T, "prefix_aucs", lambda model, frame, label, counts: scored.append(
        (frame.rdd.getNumPartitions(), frame.count())) or dict.fromkeys(counts, 0.5))
    found = T.random_search(T.training_frame(_many_pieces(spark)), C.TARGET, exclude=["id_contrato"], trials=1, folds=2)
    assert found.avgMetrics == [0.5]
    for side in (fits, scored):  # each row is once on either side of the two folds
        assert [n for n, _ in side] == [1, 1] and sum(rows for _, rows in side) == 400
