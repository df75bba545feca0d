"""M9–M14, M18, D2 invariants: exact AUC equals Spark's evaluator, drift of identical data stays in band."""

import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lendwise.operators import drift as D
from lendwise.operators import metrics as M
from lendwise.plans import train as T


def _frame(spark, n=600, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x1, x2 = rng.gauss(0, 1), rng.gauss(0, 1)
        y = 1 if x1 + 0.5 * x2 + rng.gauss(0, 0.5) > 0 else 0
        rows.append((i, x1, x2, rng.choice(["a", "b", None]), y))
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, cat string, y int")


def test_pipeline_learns_and_auc_matches_evaluator(spark):
    df = T.training_frame(_frame(spark), partitions=4)
    pipe, names = T.prepared_pipeline(df, "y", exclude=["id"], trees=15, max_depth=3)
    assert set(names) == {"x1", "x2", "cat"}
    model = pipe.fit(df)
    scored = T.score(model, df)
    ours = M.auc_table(scored, "y", "probability_1").first()["auc"]
    theirs = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="probability_1", numBins=0).evaluate(
        scored.withColumn("y", F.col("y").cast("double")))
    assert ours > 0.8 and abs(ours - theirs) < 1e-9
    imp = T.feature_importance(model, df, 15).collect()
    assert imp[0]["feature"] == "x1" and len(imp) <= 3


def test_local_model_scoring(spark):
    df = _frame(spark, 50)
    scorer = T.LinearScorer([1.0, 0.0], 0.0)
    got = T.score_with_local_model(df, ["x1", "x2"], lambda: scorer).collect()
    import math

    assert all(abs(r["prediction_proba"] - 1 / (1 + math.exp(-r["x1"]))) < 1e-12 for r in got)


def test_reconstruction_drift_identical_data_in_band(spark):
    df = _frame(spark, 2000).withColumn("x3", F.col("x1") * 2 + F.col("x2"))
    out = D.reconstruction_drift(df, df, ["x1", "x2", "x3"], ["id"], chunk_size=500).collect()
    assert len(out) == 4 and not any(r["alert"] for r in out)
    shifted = df.withColumn("x3", F.col("x3") * -1.0)
    out2 = D.reconstruction_drift(df, shifted, ["x1", "x2", "x3"], ["id"], chunk_size=500).collect()
    assert all(r["alert"] for r in out2)


def test_class_weight_balances_classes(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = {r["y"]: r["class_weight"] for r in T.with_class_weight(df, "y").distinct().collect()}
    assert w == {1: 2.0, 0: 4 / 6}
    total = T.with_class_weight(df, "y").groupBy("y").agg(F.sum("class_weight").alias("s")).collect()
    assert all(abs(r["s"] - 2.0) < 1e-12 for r in total)  # each class carries n/2


def test_reconstruction_drift_of_categories_alone(spark):
    """Numbers keep their distribution; only which categories go together shifts."""
    rng = random.Random(11)
    rows, moved = [], []
    for i in range(4000):
        kind = "a" if rng.random() < 0.85 else "b"
        rows.append((i, rng.gauss(0, 1), kind, {"a": "x", "b": "y"}[kind] if rng.random() < 0.97 else None))
        other = rng.choice(["a", "b", "never seen"])
        moved.append((i, rng.gauss(0, 1), other, {"a": "y", "b": "x"}.get(other, "x")))
    schema = "id long, amount double, kind string, place string"
    ref, same, ana = (spark.createDataFrame(r, schema) for r in (rows[:3000], rows[3000:], moved[:1000]))
    features = ["amount", "kind", "place"]
    calm = D.reconstruction_drift(ref, same, features, ["id"], chunk_size=250).collect()
    loud = D.reconstruction_drift(ref, ana, features, ["id"], chunk_size=250).collect()
    assert len(calm) == 4 and not any(r["alert"] for r in calm)
    assert len(loud) == 4 and all(r["alert"] for r in loud)
    texts = D.reconstruction_drift(ref, ana, ["kind", "place"], ["id"], chunk_size=250).collect()
    assert all(r["alert"] for r in texts)
    numbers = D.reconstruction_drift(ref, ana.withColumn("n2", F.col("amount") * 2), ["amount"], ["id"], chunk_size=250).collect()
    assert not any(r["alert"] for r in numbers)


def test_frequency_encoding(spark):
    from lendwise.operators import encoders as E

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 1)], "c string, n int")
    d = E.frequency_dictionary(df, ["c", "n"])
    assert {(r["column"], r["category"], round(r["share"], 9)) for r in d.collect()} == {
        ("c", "a", round(2 / 3, 9)), ("c", "b", round(1 / 3, 9)), ("c", None, round(2 / 3, 9)),
        ("n", "1", round(2 / 3, 9)), ("n", "2", round(1 / 3, 9)), ("n", None, round(2 / 3, 9))}
    probe = spark.createDataFrame([("b",), ("new",), (None,)], "c string")
    got = E.frequency_encode(probe, ["c"], d).collect()
    assert [(r["c"], round(r["freq_c"], 9)) for r in got] == [("b", round(1 / 3, 9)), ("new", 0.0), (None, round(2 / 3, 9))]
    assert E.frequency_dictionary(df.limit(0), ["c"]).count() == 0


def test_filler_learns_medians_and_modes_and_survives_saving(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from lendwise.plans import preparation as PREP

    df = spark.createDataFrame(
        [(1.0, True, "a", None), (None, None, "b", None), (4.0, False, "b", None), (float("nan"), True, "a", None)],
        "x double, flag boolean, s string, void string")
    numbers, texts = PREP.input_columns(df, [])
    assert (numbers, texts) == (["x", "flag"], ["s", "void"])
    model = PREP.preparation(numbers, ["s"]).fit(df)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    assert again.stages[0].values() == {"medians": {"x": 2.5, "flag": 1.0}, "modes": {"s": "a"}}
    probe = spark.createDataFrame([(1, None, None, None, "b"), (2, 9.0, True, "new", None)], "id int, x double, flag boolean, s string, void string")
    slots = {(r["id"], r["slot"], r["value"]) for r in PREP.vector_slots(again.transform(probe), "id").collect()}
    assert {(1, "x", 2.5), (1, "s=a", 1.0), (2, "x", 9.0), (2, "flag", 1.0)} <= slots
    assert not any(k == 2 and s.startswith("s=") for k, s, _ in slots)  # unseen: all zeros
    filled = PREP.ColumnFiller(numbers=[], texts=["void"]).fit(df).transform(df)
    assert filled.where("void__filled IS NOT NULL").count() == 0


def test_search_shares_fits_and_weights_classes(spark, monkeypatch):
    df = T.training_frame(_frame(spark, 400), partitions=2)
    fits = []
    real = T.booster

    def counted(label, trees, *args):
        fits.append(trees)
        return real(label, trees, *args)

    monkeypatch.setattr(T, "booster", counted)
    space = [{"trees": 3, "max_depth": 2, "step_size": 0.1}, {"trees": 6, "max_depth": 2, "step_size": 0.1},
             {"trees": 4, "max_depth": 3, "step_size": 0.05}]
    monkeypatch.setattr(T, "search_space", lambda *a: space)
    found = T.random_search(df, "y", exclude=["id"], trials=3, folds=2)
    assert sorted(fits) == [4, 4, 6, 6]  # trials of equal depth and step share a fit of the most trees
    assert len(found.avgMetrics) == 3 and all(0.7 < m <= 1 for m in found.avgMetrics)
    assert found.best == space[max(range(3), key=lambda i: found.avgMetrics[i])]


def test_prefix_of_a_model_is_the_shorter_model(spark):
    from lendwise.plans.preparation import preparation

    df = T.training_frame(_frame(spark, 300), partitions=1)
    ready = preparation(["x1", "x2"], ["cat"]).fit(df).transform(df).select("y", "features")
    long_model, short_model = T.booster("y", 8, 3).fit(ready), T.booster("y", 3, 3).fit(ready)
    a = T.prefix_aucs(long_model, ready, "y", [3, 8])
    assert a[3] == T.prefix_aucs(short_model, ready, "y", [3])[3] and a[3] != a[8]


def test_search_space_keeps_its_ranges():
    for c in T.search_space(200, (100, 500), (3, 10), (-2.0, -1.0), 1):
        assert 100 <= c["trees"] <= 500 and 3 <= c["max_depth"] <= 10 and 0.01 <= c["step_size"] <= 0.1


def test_category_codes_come_from_the_training_side(spark):
    from lendwise.operators.encoders import hash_split
    from lendwise.plans.assemble import split_credit_features

    rows = [(i, f"k{i}" if i % 9 == 0 else "common", 1.0, 2.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id_contrato long, tipo_contrato string, valor_credito double, valor_bem double")
    train = {r["id_contrato"]: r["is_train"] for r in hash_split(df, "id_contrato").collect()}
    got = {r["id_contrato"]: r for r in split_credit_features(df).collect()}
    assert all(got[i]["is_train"] == train[i] for i in train)
    unseen = [i for i in train if not train[i] and i % 9 == 0]
    assert unseen and all(got[i]["feat_tipo_contrato_enc"] == -1.0 for i in unseen)
    assert all(got[i]["feat_tipo_contrato_enc"] >= 0 for i in train if train[i])
