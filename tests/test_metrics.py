"""M14–M17 and W3 against brute force on small fixtures (score_values)."""

import random

from pyspark.sql import functions as F

from lendwise.operators import metrics as M
from lendwise.operators.ordering import chunk_numbers


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairwise(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = M.auc_table(df, "y", "p", partitions=7).first()["auc"]
    assert abs(got - _brute_auc(rows)) < 1e-12


def test_auc_grouped_and_one_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.1), ("b", 1, 0.5), ("b", 1, 0.6), ("c", None, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r["auc"] for r in M.auc_table(df, "y", "p", by=["g"]).collect()}
    assert got["a"] == _brute_auc([(1, 0.9), (0, 0.1), (1, 0.1)])
    assert got["b"] is None and "c" not in got


def test_prf_confusion_sweep(spark):
    rows = [(1, 0.3), (1, 0.5), (0, 0.31), (0, 0.1), (1, 0.95), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, p double")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(df, "y", "p", 0.3).collect()}
    assert cm == {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 2}
    sw = {(r["threshold"], r["class"]): r for r in M.threshold_sweep(df, "y", "p").collect()}
    assert sw[(0.5, 1)]["precision"] == 2 / 3 and sw[(0.5, 1)]["recall"] == 2 / 3
    assert sw[(0.9, 1)]["precision"] == 1.0 and abs(sw[(0.9, 0)]["accuracy"] - 4 / 6) < 1e-12
    pr = {r["class"]: r for r in M.per_class_prf(df.withColumn("yhat", (F.col("p") > 2).cast("int")), "y", "yhat").collect()}
    assert pr[1]["precision"] == 0.0 and pr[1]["f1"] == 0.0 and pr[0]["recall"] == 1.0


def test_chunk_numbers_match_sequential_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 30)) for i in range(2300)]  # many ties on ts, unique id tie-break
    df = spark.createDataFrame(rows, "id long, ts int")
    got = {r["id"]: r["chunk"] for r in chunk_numbers(df, ["ts", "id"], 500, partitions=6).collect()}
    expected = {i: n // 500 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == expected


def test_hot_key_third_of_rows(spark):
    """One timestamp / one group holding a third of the rows: results stay exact."""
    import numpy as np

    from lendwise.operators.ordering import prefix_sums, rank_quantiles

    rng = random.Random(9)
    rows = [(i, 7 if i % 3 == 0 else rng.randint(0, 1000), "hot" if i % 3 == 0 else rng.choice("abc"),
             rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ts int, g string, v double")
    got = {r["id"]: r["chunk"] for r in chunk_numbers(df, ["ts", "id"], 500, partitions=8).collect()}
    expected = {i: n // 500 for n, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == expected
    ones = df.withColumn("one", F.lit(1).cast("bigint"))
    pids = prefix_sums(ones, ["ts", "id"], ["one"], partitions=8)
    assert pids.count() == 3000
    med = {r["g"]: r["m"] for r in rank_quantiles(df, "v", [0.5], ["m"], by=["g"], partitions=8).collect()}
    assert abs(med["hot"] - float(np.median([r[3] for r in rows if r[2] == "hot"]))) < 1e-12
