"""Sampling dials, coherence, regressors, statistics and verdict rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.operators import coherence as CO
from probelake.operators import regressors as RG
from probelake.operators import sampling as SA
from probelake.operators import scoring as SC
from probelake.operators import splits as SP
from probelake.operators import stats as ST
from probelake.operators import targets as TG
from probelake.operators import verdicts as VD


def test_sampler(spark):
    base = spark.range(400)
    rows = SA.sample_material(base, "id", seed=3)
    again = SA.sample_material(base.repartition(7), "id", seed=3)
    cols = [*K.FACTOR_FIELDS, "density", "friction", "restitution", "metallic", "roughness", "nearest_anchor"]
    assert sorted(map(tuple, rows.select("id", *cols).collect())) == sorted(map(tuple, again.select("id", *cols).collect()))
    limits = rows.agg(F.min("density"), F.max("density"), F.min("roughness"), F.max("roughness"), F.avg("clarity")).first()
    assert 50 <= limits[0] and limits[1] <= 8000 and limits[2] >= 0.02 and limits[3] <= 1.0 and 0.15 < limits[4] < 0.35

    def r(alpha, gain=1.0):
        return SA.coupling(SA.sample_material(base, "id", seed=3, alpha=alpha, gain=gain), "metallic", "heaviness").first()["r"]

    zero, half, full = r(0.0), r(0.5), r(1.0)
    assert abs(zero) < 0.2 and full > 0.5 and zero < half < full and r(1.0, 8.0) > full
    physics = lambda d: sorted(map(tuple, d.select("id", "density", "friction", "restitution").collect()))
    assert physics(rows) == physics(SA.sample_material(base, "id", seed=3, alpha=0.0, gain=8.0))
    for bad in ({"alpha": 1.5}, {"gain": 0.5}):
        with pytest.raises(ValueError):
            SA.sample_material(base, "id", **bad)


def test_directions_match_columns(spark):
    from probelake.functions.hashing import gaussian

    block = SA.direction_block([7, 8], 3, 4, 5)
    for n, key in enumerate((7, 8)):
        row = spark.range(1).select(*[gaussian(5, "direction", F.lit(key), F.lit(d), F.lit(j)).alias(f"g{d}_{j}") for d in range(4) for j in range(3)]).first()
        assert np.allclose(block[n].ravel(), list(row))


def test_coherence(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(8, 5))
    rows = [(i, [float(v) for v in rng.normal(size=8)], [float(v) for v in rng.normal(size=8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, z array<double>, y array<double>")
    f = lambda z: np.tanh(z @ w)
    shared = CO.coherence(CO.response_magnitudes(df, f, f, 8)).first()
    assert shared["coherence"] == pytest.approx(1.0) and shared["n_samples"] == 40
    split = CO.coherence(CO.independent_magnitudes(df, f, f, 8, 8, render="z", target="y")).first()["coherence"]
    assert abs(split) < 0.15
    loss = CO.coherence_alignment_loss(CO.response_magnitudes(df, f, f, 8)).first()["loss"]
    assert loss == pytest.approx(0.0, abs=1e-9)
    flat = CO.coherence(CO.response_magnitudes(df, f, lambda z: z[:, :1] * 0, 8)).first()["coherence"]
    assert flat == 0.0


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 3)) * [1, 10, 100] + [5, -3, 70]
    y = x @ rng.normal(size=(3, 2)) + [1.0, -2.0]
    rows = [(i, [float(v) for v in a], [float(v) for v in b], "test" if i % 4 == 0 else "train") for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, x array<double>, y array<double>, split string"), x, y


def test_ridge(linear):
    df, x, y = linear
    pred = {r["id"]: r["prediction"] for r in RG.ridge(df, "x", "y", alpha=1e-9).collect()}
    assert np.allclose([pred[i] for i in range(160)], y, atol=1e-6)
    tr = np.arange(160) % 4 != 0
    mu, sd = x[tr].mean(0), x[tr].std(0)
    a = np.c_[(x[tr] - mu) / sd, np.ones(tr.sum())]
    reg = np.diag([2.0, 2.0, 2.0, 0.0])
    want = np.c_[(x - mu) / sd, np.ones(160)] @ np.linalg.solve(a.T @ a + reg, a.T @ y[tr])
    pred = {r["id"]: r["prediction"] for r in RG.ridge(df, "x", "y", alpha=2.0).collect()}
    assert np.allclose([pred[i] for i in range(160)], want)


def test_best_oracle_and_gain(linear):
    df, _, y = linear
    best = RG.best_oracle(df, "x", "y", 3).first()
    assert best["regressor"] in ("ridge-linear", "ridge-quad") and best["gain"] > 100 and best["train_gain"] > 100
    tr = np.arange(160) % 4 != 0
    mean_pred = df.withColumn("p", F.array(*[F.lit(float(v)) for v in y[tr].mean(0)]))
    assert SC.gain(mean_pred, "y", "p").first()["gain"] == pytest.approx(1.0)
    assert SC.gain(df.withColumn("p", F.col("y")), "y", "p").first()["gain"] == math.inf
    assert SC.gain(df.withColumn("p", F.col("y")), "y", "p", zero="null").first()["gain"] is None


def test_quadratic_guard(spark):
    assert TG.quadratic_width(3) == 9
    got = spark.range(1).select(TG.quadratic(F.array(F.lit(2.0), F.lit(3.0)), 2).alias("q")).first()["q"]
    assert sorted(got) == [2.0, 3.0, 4.0, 6.0, 9.0]
    with pytest.raises(ValueError):
        TG.quadratic(F.array(), 500)


def test_kfold_r2(linear):
    df, x, y = linear
    noise = df.withColumn("y", F.array(F.col("y")[0], F.rand(3)))
    r2 = {r["pos"]: r["r2"] for r in RG.kfold_r2(SP.kfold(noise, "id", 5, 1), "x", "y").collect()}
    assert r2[0] > 0.999 and r2[1] < 0.2


def test_quantize(spark):
    rows = [(i, [float(i % 3) * 10 + 0.01 * (i % 7)], "train" if i % 5 else "test") for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, e array<double>, split string")
    out, k = RG.quantize(df, "e", 3, seed=1)
    assert k == 3
    groups = {}
    for r in out.collect():
        groups.setdefault(r["cluster"], set()).add(round(r["e"][0]) // 10)
    capped, k = RG.quantize(df.where("id < 6"), "e", 50)
    assert k == 4 and capped.count() == 6  # ids 0 and 5 are test rows
    assert len(groups) <= 3


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", 2.0), ("b", 2.5), ("c", 9.0)], "g string, v double")
    a, b = np.array([1.0, 3.0, 8.0]), np.array([2.0, 2.5])
    w = ST.welch_between(df, "v", "g", "a", "b").first()
    assert w["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 3 + b.var(ddof=1) / 2))
    assert math.isnan(ST.welch_between(df, "v", "g", "a", "c").first()["t"])
    one = df.groupBy("g").agg(ST.one_sample_t("v").alias("t"), ST.sample_sd("v").alias("sd"))
    got = {r["g"]: (r["t"], r["sd"]) for r in one.collect()}
    assert got["a"][0] == pytest.approx(a.mean() / (a.std(ddof=1) / math.sqrt(3))) and math.isnan(got["c"][0]) and got["c"][1] == 0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(ST.pearson("x", "y").alias("r")).first()["r"] == 0.0
    with pytest.raises(Exception, match="too few points"):
        flat.limit(1).agg(ST.pearson("x", "y")).collect()
    s = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 4.0), (3, 2.0, 9.0)], "i int, x double, y double")
    rx, ry = np.array([0, 1, 2]), np.array([1, 0, 2])
    assert ST.spearman(s, "x", "y", ["i"]).first()["rho"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_verdicts(spark):
    rows = [(0.2, 3.0, True), (0.2, 1.0, True), (0.01, 0.0, True), (0.2, math.nan, True), (0.2, 3.0, False)]
    df = spark.createDataFrame(rows, "p double, t double, ok boolean")
    got = [r["v"] for r in df.select(VD.decide("p", "t", 0.05, 2.5, 0.03, "ok").alias("v")).collect()]
    assert got == ["RISES", "INCONCLUSIVE", "NULL", "INCONCLUSIVE", "VOID"]
    arms = spark.createDataFrame([("a", 9.0, 0.01), ("b", 7.0, 0.2), ("c", 9.0, None)], "arm string, pr double, indep double")
    gated = {r["arm"]: (r["notes"], r["passed"]) for r in VD.apply_gates(arms, VD.coherence_gates("pr", "indep")).collect()}
    assert gated["a"] == ([], True) and len(gated["b"][0]) == 2 and gated["c"][0] == ["control not measured"]
    series = [("up", i, float(i)) for i in range(4)] + [("mix", i, float(i % 2)) for i in range(4)] + [("gap", i, None if i == 2 else 1.0) for i in range(4)]
    dose = {r["name"]: r["direction"] for r in VD.dose_response(spark.createDataFrame(series, "name string, k int, v double"), "name", "k", "v").collect()}
    assert dose == {"up": "monotone up", "mix": "mixed", "gap": "incomplete"}
    levels = spark.createDataFrame([(1.0,), (1.2,), (1.4,)], "g double")
    assert [r[0] for r in levels.select(VD.headroom("g")).collect()] == ["UNPREDICTABLE", "INTACT", "GONE"]


def test_retention_and_fraction(spark):
    t = spark.createDataFrame([("r", 0.6), ("m", 0.3)], "channel string, r2 double")
    u = spark.createDataFrame([("r", 0.8), ("m", 0.05)], "channel string, r2 double")
    got = {r["channel"]: r["retention"] for r in SC.retention(t, u).collect()}
    assert got["r"] == pytest.approx(0.75) and math.isnan(got["m"])
    g = spark.createDataFrame([(1.5, 1.0, 2.0), (1.5, 2.0, 1.0)], "g double, s double, c double")
    f = [r["fraction"] for r in SC.extraction_fraction(g, "g", "s", "c").collect()]
    assert f[0] == 0.5 and math.isnan(f[1])


def test_large_offsets_do_not_eat_the_digits(spark):
    from probelake.operators.alignment import linear_cka
    from probelake.operators.regressors import kfold_r2

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    rows = [(i % 5, [*(1e8 + v).tolist(), 1234.567], (1e8 + 2 * v[:1]).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "fold int, x array<double>, y array<double>")
    assert kfold_r2(df, "x", "y").first()["r2"] > 0.99
    same = df.select("x", F.transform("x", lambda v: v * 2.0 + 5.0).alias("z"))
    assert linear_cka(same, "x", "z", 4).first()["cka"] == pytest.approx(1.0, abs=1e-6)


def test_hypergeometric_inversion_has_the_exact_law():
    from probelake.operators.agreement import inverse_hypergeometric

    good, bad, draws = 7, 9, 6
    weight = [math.comb(good, k) * math.comb(bad, draws - k) for k in range(draws + 1)]
    cdf = np.cumsum(weight) / sum(weight)
    for u in np.linspace(0.001, 0.999, 97):
        assert inverse_hypergeometric(float(u), good, bad, draws) == int(np.searchsorted(cdf, u))
    big = 5 * 10**10
    got = [inverse_hypergeometric(u, big, big, big // 10) for u in (0.1586553, 0.5, 0.8413447)]
    sd = (big / 10 * 0.25 * 0.95) ** 0.5
    assert abs(got[1] - big / 20) < 2 and got[2] - got[1] == pytest.approx(sd, rel=0.01) and got[1] - got[0] == pytest.approx(sd, rel=0.01)
    assert inverse_hypergeometric(0.3, 0, 5, 3) == 0 and inverse_hypergeometric(0.3, 5, 0, 3) == 3


def test_code_domain_reads_every_entry(spark, tmp_path):
    from probelake.plans.catalogue import QUERIES

    def count(*rows):
        folder = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        spark.createDataFrame([(i, 0, r) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
        return QUERIES["F10_code_domain"](spark, folder).first()["n"]

    good = [0.1 * (i % 3 - 1) for i in range(64)]
    assert count(good, good) == 2
    with pytest.raises(Exception, match="code values must be"):
        count(good, [*good[:50], None, *good[51:]])


def test_code_report_has_all_marginals(spark):
    from probelake.operators.reports import code_report

    rows = [(i, run, (i * run) % 3 - 1 if i % 2 else 1, i % 2) for i in range(12) for run in (1, 2)]
    out = code_report(spark.createDataFrame(rows, "id int, run int, code int, shape int"), "id", "run", "code", {"shape": "shape"}, draws=5)
    got = {(r["item"], r["measure"]): r["value"] for r in out.collect()}
    for run in (1, 2):
        codes = [c for _, r, c, _ in rows if r == run]
        for name, v in (("minus", -1), ("zero", 0), ("plus", 1)):
            assert got[str(run), f"{name}_share"] == pytest.approx(codes.count(v) / 12)
