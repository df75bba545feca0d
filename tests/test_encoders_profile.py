"""M4–M8, P6, A11, A13, F3 on encode_train / encode_apply / months fixtures."""

import datetime as dt

from lendwise.operators import encoders as E
from lendwise.operators import profile as PR


def test_median_mode_ordinal(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("a", 4.0), (None, None)], "c string, x double")
    apply = spark.createDataFrame([("z", None), (None, 5.0), ("a", None)], "c string, x double")
    med = [r["x"] for r in E.fill_with_quantile(apply, ["x"], fitted=train).collect()]
    assert med == [2.5, 5.0, 2.5]  # even count → midpoint
    modes = {r["column"]: r["mode"] for r in E.mode_table(train, ["c"]).collect()}
    assert modes == {"c": "a"}  # tie a/b → smallest
    d = E.ordinal_dictionary(train, ["c"])
    codes = {r["category"]: r["code"] for r in d.collect()}
    assert codes == {"Missing": 0.0, "a": 1.0, "b": 2.0}
    enc = E.ordinal_encode(apply, ["c"], d).orderBy("x").collect()
    got = sorted((r["c"], r["feat_c_enc"]) for r in enc if r["c"] is not None)
    assert got == [("a", 1.0), ("z", -1.0)]
    assert [r["feat_c_enc"] for r in enc if r["c"] is None] == [0.0]
    oh = E.one_hot(apply, {"c": ["a", "b"]}).collect()
    assert all(r["c_b"] == 0 for r in oh)
    assert sum(r["c_a"] for r in oh) == sum(r["c"] == "a" for r in oh)


def test_histogram_survives_an_outlier(spark):
    df = spark.createDataFrame([(1.0,), (1e15,)], "x double")
    rows = PR.fixed_width_histogram(df, "x", 20000.0, origin=0.0, zero_fill=False).collect()
    assert sorted((r["count"], r["pct"]) for r in rows) == [(1, 50.0), (1, 50.0)]
    few = PR.fixed_width_histogram(spark.createDataFrame([(0.5,), (70000.5,)], "x double"), "x", 1.0, origin=0.0)
    assert few.count() == 70001 and few.where("count > 0").count() == 2  # more bins than one step of the grid


def test_hash_split_is_stateless(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = E.hash_split(df, "k").where("is_train").count()
    b = E.hash_split(df.repartition(7), "k").where("is_train").count()
    assert a == b and 700 < a < 900


def test_histogram_last_bin_closed_and_months(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,)], "x double")
    h = {r["bin"]: r["count"] for r in PR.fixed_width_histogram(df, "x", 1.0).collect()}
    assert h == {0: 1, 1: 3}  # arange(0, 3, 1) → edges 0,1,2: [0,1) [1,2] (last bin closed)
    h1 = {r["bin"]: r["count"] for r in PR.fixed_width_histogram(df, "x", 1.0, stop_pad=2.0).collect()}
    assert h1 == {0: 1, 1: 2, 2: 1}  # arange(0, 4) → edges 0,1,2,3
    h2 = {r["bin"]: r["count"] for r in PR.fixed_width_histogram(df, "x", 1.0, origin=0.0, stop=2.0).collect()}
    assert h2 == {0: 2}  # edges 0,1: one closed bin, values above 1 are not counted
    m = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 31),), (dt.date(2024, 4, 30),), (None,)], "d date")
    got = [(r["month"], r["count"]) for r in PR.monthly_counts(m, "d", "end").orderBy("month").collect()]
    assert got == [(dt.date(2024, 1, 31), 2), (dt.date(2024, 2, 29), 0), (dt.date(2024, 3, 31), 0),
                   (dt.date(2024, 4, 30), 1)]


def test_clip_describe_box(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    assert PR.clip_at_quantile(df, "x", 0.99).count() == 99
    d = PR.describe(df, ["x"]).first()
    assert (d["count"], d["p25"], d["p50"], d["max"]) == (100, 25.75, 50.5, 100.0)
    b = PR.box_stats(df.union(df.sparkSession.createDataFrame([(1000.0,)], "x double")), "x").first()
    assert b["n_outliers"] == 1 and b["whisker_high"] == 100.0


def test_rank_quantiles_match_numpy_on_continuous_values(spark):
    import random

    import numpy as np

    from lendwise.operators.ordering import rank_quantiles

    rng = random.Random(11)
    rows = [(rng.choice(["x", "y"]), rng.uniform(-5, 5)) for _ in range(1501)] + [("y", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in
           rank_quantiles(df, "v", [0.1, 0.5, 0.99], ["a", "b", "c"], by=["g"], partitions=3).collect()}
    for g in ("x", "y"):
        vals = np.array([v for k, v in rows if k == g and v is not None])
        assert np.allclose(got[g], np.quantile(vals, [0.1, 0.5, 0.99]), rtol=0, atol=1e-12)


def test_stratified_split_exact_counts(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int")
    out = E.stratified_split(df, "k", "y", 0.8, 42)
    got = {(r["y"], r["is_train"]): r["n"] for r in out.groupBy("y", "is_train").count().withColumnRenamed("count", "n").collect()}
    n1 = sum(1 for _, y in rows if y == 1)
    n0 = 1000 - n1
    assert got[(1, True)] == round(n1 * 0.8) and got[(0, True)] == round(n0 * 0.8)
    again = {r["k"] for r in E.stratified_split(df.repartition(5), "k", "y", 0.8, 42).where("is_train").collect()}
    assert again == {r["k"] for r in out.where("is_train").collect()}


def test_value_counts_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("c",), (None,)], "v string")
    by_count = [(r["v"], r["count"]) for r in PR.value_counts(df, "v", sort="count").collect()]
    assert by_count == [("b", 2), ("c", 2), ("a", 1)]
    assert [r["v"] for r in PR.value_counts(df, "v", sort="key").collect()] == ["a", "b", "c"]
    assert abs(sum(r["pct"] for r in PR.value_counts(df, "v").collect()) - 100.0) < 1e-9


def test_kde_grid_matches_brute_force(spark):
    import math
    import random

    rng = random.Random(4)
    vals = [float(rng.randint(-10, 40)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["grid_index"]: (r["x"], r["density"]) for r in PR.kde_grid(df, "x", grid_size=50).collect()}
    n = len(vals)
    mean = sum(vals) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in vals) / (n - 1))
    h = sd * n ** -0.2
    lo, hi = min(vals), max(vals)
    for i in (0, 17, 49):
        g = lo + i * (hi - lo) / 49
        dens = sum(math.exp(-0.5 * ((g - v) / h) ** 2) for v in vals) / (n * h * math.sqrt(2 * math.pi))
        assert abs(got[i][0] - g) < 1e-6 and abs(got[i][1] - dens) < 1e-10
    approx = {r["grid_index"]: r["density"] for r in PR.kde_grid(df, "x", grid_size=50, prebin=4096).collect()}
    assert all(abs(approx[i] - got[i][1]) < 1e-4 for i in got)


def test_equal_bins_match_numpy_histogram(spark):
    import random

    import numpy as np

    rng = random.Random(8)
    vals = [rng.uniform(0, 100) for _ in range(2000)] + [0.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["bin"]: r["count"] for r in PR.equal_bins_histogram(df, "x", 40).collect()}
    counts, _ = np.histogram(np.array(vals), bins=40)
    assert [got.get(i, 0) for i in range(40)] == counts.tolist()


def test_predicate_fraction_and_missingness(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, "a"), (None, "b"), (4, None)], "a int, b string")
    assert PR.predicate_fraction(df, F.col("a") > 1).first()[0] == 0.5  # NULL comparison counts as false
    pats = {r["pattern"]: r["count"] for r in PR.missingness_patterns(df).collect()}
    assert pats == {"01": 2, "00": 1, "10": 1}
    shp = PR.shape(df, "a").first()
    assert (shp["n_rows"], shp["n_columns"], shp["n_distinct_ids"], shp["n_ids"]) == (4, 2, 3, 3)
    nul = {r["column"]: r["null_pct"] for r in PR.null_pct(df).collect()}
    assert nul == {"a": 25.0, "b": 50.0}


def test_counts_top_k_summary_and_head(spark):
    df = spark.createDataFrame([("a", 1, -2), ("b", 1, 0), ("b", 2, 5), ("c", None, None), (None, 3, 10)],
                               "c string, n int, atraso int")
    many = {(r["column"], r["value"]): (r["count"], r["pct"]) for r in PR.value_counts_many(df, ["c", "n"]).collect()}
    assert many[("c", "b")] == (2, 50.0) and many[("n", "1")] == (2, 50.0) and ("c", None) not in many
    top = [(r["c"], r["count"], r["pct"]) for r in PR.top_categories(df, "c", 2).collect()]
    assert top == [("b", 2, 40.0), ("a", 1, 20.0)]  # ties broken by value; pct over all 5 rows
    s = PR.lateness_summary(df, "atraso").first()
    assert (s["total"], s["em_dia"], s["atrasados"], s["mediana"]) == (5, 3, 2, 2.5)
    med = {r["c"]: (r["quantidade"], r["valor_mediano"]) for r in PR.category_count_median(df, "c", "n", "n").collect()}
    assert med["b"] == (2, 1.5) and med["c"] == (0, None)
    assert [r["n"] for r in PR.head(df, ["n"], 2).collect()] == [None, 1]
    assert PR.drop_null_rows(df, ["c", "n"]).count() == 3
    assert sorted(r["c"] for r in PR.distinct_values(df, "c").collect() if r["c"]) == ["a", "b", "c"]
