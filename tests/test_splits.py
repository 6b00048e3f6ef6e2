"""Splits: coverage, disjointness, sizes, determinism under repartitioning."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probelake.operators import ranking as RK
from probelake.operators import splits as SP

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@quick
@given(st.integers(1, 6), st.integers(1, 6), st.floats(0, 0.9), st.integers(0, 50))
def test_combination_split(spark, n_s, n_m, frac, seed):
    df = spark.createDataFrame([(f"s{i}", f"m{j}") for i in range(n_s) for j in range(n_m)], "s string, m string")
    rows = SP.combination_split(df, "s", "m", frac, seed).collect()
    train = {(r["shape"], r["material"]) for r in rows if r["split"] == "train"}
    test = {(r["shape"], r["material"]) for r in rows if r["split"] == "test"}
    assert len(train) + len(test) == n_s * n_m and not train & test
    assert {s for s, _ in train} == {f"s{i}" for i in range(n_s)} and {m for _, m in train} == {f"m{j}" for j in range(n_m)}
    assert len(test) == min(round(n_s * n_m * frac), n_s * n_m - max(n_s, n_m))


@quick
@given(st.integers(1, 40), st.floats(0, 1), st.integers(0, 50))
def test_object_split(spark, n, frac, seed):
    df = spark.range(n).withColumnRenamed("id", "oid")
    got = {r["oid"]: r["split"] for r in SP.object_split(df, "oid", frac, seed).collect()}
    again = {r["oid"]: r["split"] for r in SP.object_split(df.repartition(5), "oid", frac, seed).collect()}
    assert got == again and sum(v == "test" for v in got.values()) == min(n - 1, round(n * frac))


def test_category_guard(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "oid string, cat string")
    held = SP.category_split(df, "cat", held=["x", "y", "nope"])
    assert {(r["oid"], r["split"]) for r in held.collect()} == {("a", "test"), ("b", "train"), ("c", "train")}
    with pytest.raises(ValueError):
        SP.category_split(df.where("false"), "cat")


def test_plan_split(spark):
    df = spark.createDataFrame([("a", "unknown"), ("b", "unknown"), ("c", "unknown")], "oid string, cat string")
    assert SP.plan_split(df, "oid", "cat", frac=0.4).where("split = 'test'").count() == 1
    known = spark.createDataFrame([("a", "mug"), ("b", "shoe"), ("c", "shoe")], "oid string, cat string")
    named = SP.plan_split(known, "oid", "cat", holdout_categories=[" Shoe ", ""])
    assert {r["oid"] for r in named.where("split = 'test'").collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        SP.plan_split(known, "oid", "cat", kind="region")


def test_regions(spark):
    df = spark.createDataFrame([(0.9, 0.3, 0.8), (0.9, 0.3, 0.2), (0.55, 0.0, 0.9), (1.02, 0.0, 0.8)],
                               "density double, friction double, restitution double")
    axes = {a: a for a in ("density", "friction", "restitution")}
    assert [r["split"] for r in SP.region_split(df, "extrapolation", axes).collect()] == ["test", "train", "test", "train"]
    assert df.where(SP.in_region({}, axes)).count() == 0
    assert df.where(SP.in_region({"friction": (0.5, 0.8)}, {**axes, "friction": F.lit(0.8)})).count() == 4
    assert df.where(SP.in_region({"friction": (0.5, 0.8)}, {**axes, "friction": F.lit(0.81)})).count() == 0


def test_kfold_sizes(spark):
    counts = sorted(r["count"] for r in SP.kfold(spark.range(23), "id", 5, 3).groupBy("fold").count().collect())
    assert counts == [4, 4, 5, 5, 5]


def test_batches(spark):
    b = SP.batches(spark.range(10), ["id"], 4, seed=1)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [2, 4, 4]
    assert SP.batches(spark.range(10), ["id"], 4, seed=1, drop_last=True).count() == 8


def test_ranks_and_percentiles_with_hot_value(spark):
    """One value and one group hold most rows: ranks stay a permutation, percentiles stay exact."""
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else "cold", 5.0 if i % 2 else float(rng.normal()), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(7)
    ranked = RK.sorted_rank(df, ["v", "i"], ["g"]).collect()
    for g in ("hot", "cold"):
        want = sorted((v, i) for gg, v, i in rows if gg == g)
        assert [(r["v"], r["i"]) for r in sorted((r for r in ranked if r["g"] == g), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in ranked if r["g"] == g) == list(range(1, len(want) + 1))
    got = {(r["g"], r["fraction"]): r["percentile"] for r in RK.exact_percentiles(df, "v", [0.0, 0.25, 1 / 3, 0.99, 1.0], ["g"]).collect()}
    for (g, f), p in got.items():
        assert p == pytest.approx(np.quantile([v for gg, v, _ in rows if gg == g], f), abs=1e-12)
    whole = {r["fraction"]: r["percentile"] for r in RK.exact_percentiles(df, "v", [0.1, 0.9]).collect()}
    assert whole[0.1] == pytest.approx(np.quantile([v for _, v, _ in rows], 0.1))
    seeded = sorted(r["rank"] for r in RK.seeded_rank(df, 4, "i").collect())
    assert seeded == list(range(1, 3001))
