"""Exact quantiles by bracket and refine, and numbering over literal ranges, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendwise.operators import ordering as O

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _groups():
    rng = random.Random(3)
    groups = {
        "wide": [rng.gauss(0, 1e6) for _ in range(9000)],
        "ties": [float(rng.randrange(4)) for _ in range(8000)],
        "hot": [7.0] * 6000 + [rng.random() for _ in range(2000)],
        "few": [3.0, 1.0, 2.0, None],
        "one": [5.0],
        "none": [None, None],
        "far": [float("inf"), -float("inf"), 0.0, 1e308, -1e308] + [float(i) for i in range(3000)],
        None: [1.0, 2.0],
    }
    return groups, [(g, v) for g, vs in groups.items() for v in vs]


@pytest.mark.parametrize("few_groups", [True, False])
def test_quantiles_of_groups_equal_numpy(spark, few_groups):
    groups, rows = _groups()
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    names = [f"p{i}" for i in range(len(QS))]
    # a coarse sketch: brackets are far smaller than the large groups
    got = {r["g"]: [r[n] for n in names] for r in O.rank_quantiles(df, "v", QS, names, by=["g"], accuracy=500, few_groups=few_groups).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, values in groups.items():
        kept = sorted(v for v in values if v is not None)
        for q, x in zip(QS, got.get(g, [])):
            at = (len(kept) - 1) * q
            lo, hi = kept[int(np.floor(at))], kept[int(np.ceil(at))]
            assert x == (lo if lo == hi else pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-12))


def test_quantiles_without_groups(spark):
    rng = random.Random(5)
    values = [rng.expovariate(1.0) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = O.rank_quantiles(df, "v", [0.5, 0.999], ["m", "t"], accuracy=400).first()
    assert row["m"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12)
    assert row["t"] == pytest.approx(np.quantile(values, 0.999), rel=1e-12)
    empty = O.rank_quantiles(df.where("v IS NULL"), "v", [0.5], ["m"]).collect()
    assert [r["m"] for r in empty] == [None]


def test_brackets_leave_most_rows_unranked(spark):
    """A bracket holds a small part of a large group, however its values lie."""
    df = spark.range(100_000).select((F.col("id") * 17 % 100_003).cast("double").alias("v"))
    plan = O.rank_quantiles(df, "v", [0.5], ["m"], accuracy=1000)
    assert plan.first()["m"] == pytest.approx(np.median([(i * 17) % 100_003 for i in range(100_000)]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and "repartition" not in text.lower()


@pytest.mark.parametrize("partitions", [1, 3, 40, None])
def test_prefix_sums_over_every_kind_of_key(spark, partitions):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        stamp = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**7)) if i % 5 else None
        rows.append((rng.choice([1.5, float("nan"), None, -2.0]), stamp, None if stamp is None else stamp.date(), rng.choice(["a", "b", None]), i, rng.randrange(9)))
    df = spark.createDataFrame(rows, "x double, t timestamp_ntz, d date, s string, i long, v long").repartition(4)
    order = ["x", "t", "d", "s", "i"]
    got = {r["i"]: r["v_cum"] for r in O.prefix_sums(df, order, ["v"], partitions).collect()}
    nulls_first = lambda v: (v is not None, (v != v, 0.0 if v != v else v) if isinstance(v, float) else v)
    total, expect = 0, {}
    for r in sorted(rows, key=lambda r: [nulls_first(c) for c in r[:5]]):
        total += r[5]
        expect[r[4]] = total
    assert got == expect
    before = {r["i"]: r["v_b"] for r in O.prefix_sums(df, order, ["v"], partitions, inclusive=False, suffix="_b").collect()}
    assert all(before[r[4]] == expect[r[4]] - r[5] for r in rows)


def test_numbering_of_an_empty_frame_and_of_equal_stamps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), i) for i in range(1000)], "t timestamp, i long")
    got = sorted((r["i"], r["chunk"]) for r in O.chunk_numbers(df, ["t", "i"], 100).collect())
    assert got == [(i, i // 100) for i in range(1000)]
    assert O.chunk_numbers(df.limit(0), ["t", "i"], 100).count() == 0
    pid = df.select(O.range_ids(df, ["t", "i"], 8).alias("p")).groupBy("p").count().collect()
    assert len(pid) == 8 and max(r["count"] for r in pid) < 400  # one hot stamp is split
