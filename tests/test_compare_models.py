"""Coherence of several arms from one pass over the perturbations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.operators import coherence as CO
from probelake.plans.study_queries import compare


def test_one_pass_equals_separate_tables(spark):
    rng = np.random.default_rng(4)
    pairs = spark.createDataFrame([(i, rng.normal(size=5).tolist(), rng.normal(size=3).tolist()) for i in range(90)], "id bigint, x array<double>, y array<double>")
    f, g, h = (lambda z: z[:, :2] ** 2), (lambda z: z[:, 1:3] * [3.0, 1.0]), (lambda z: np.abs(z[:, 2:3]))
    shared = CO.response_magnitudes(pairs, f, {"a": g, "b": h}, 5, vec="x", n_dirs=6)
    untrained = CO.response_magnitudes(pairs, f, {"a": h, "b": h}, 5, vec="x", n_dirs=6)
    apart = CO.independent_magnitudes(pairs, f, {"a": h, "b": g}, 5, 3, render="x", target="y", n_dirs=6)
    want = {r["target"]: r.asDict() for r in CO.compare(shared, apart, untrained).collect()}

    left, right = (lambda d: lambda z: d(z[:, :5])), (lambda d: lambda z: d(z[:, 5:]))
    r, a, b = left(f), left(g), left(h)
    arms = {"shared": {"a": (r, a), "b": (r, b)}, "independent": {"a": (r, right(h)), "b": (r, right(g))}, "untrained": {"a": (r, b), "b": (r, b)}}
    out = CO.compare_models(pairs.select("id", F.concat("x", "y").alias("z")), arms, 8, n_dirs=6)
    got = {r["target"]: r.asDict() for r in out.collect()}
    assert set(got) == set(want) == {"a", "b"}
    for t in want:
        assert got[t].pop("target") == want[t].pop("target") and got[t] == pytest.approx(want[t], abs=1e-12)


def test_compare_draws_each_direction_once(spark):
    plan = compare(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
