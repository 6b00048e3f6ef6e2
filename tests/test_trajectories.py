"""Trajectory summaries: hand-computed fixtures, banded execution against the plain one, a hot trajectory."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probelake.operators import trajectories as TR
from probelake.operators.ranking import value_bands

SCHEMA = "traj string, frame_idx int, t double, pos array<double>, up array<double>"


def frames(spark, **trajectories):
    rows = []
    for name, fs in trajectories.items():
        rows += [(name, i, float(t), [float(v) for v in p], [float(v) for v in u]) for i, (t, p, u) in enumerate(fs)]
    return spark.createDataFrame(rows, SCHEMA)


def upright(zs, x=0.0, t0=0.0):
    return [(t0 + 0.1 * i, (x, 0, z), (0, 0, 1)) for i, z in enumerate(zs)]


def loop(fs):
    """Independent per-trajectory loop used as brute force."""
    t = [f[0] for f in fs]
    p = [np.array(f[1], float) for f in fs]
    d = [np.linalg.norm(p[i] - p[i - 1]) for i in range(1, len(p))]
    dt = [max(1e-9, t[i] - t[i - 1]) for i in range(1, len(p))]
    vz = [(p[i][2] - p[i - 1][2]) / dt[i - 1] for i in range(1, len(p))]
    moving = [i + 1 for i in range(len(d)) if d[i] / dt[i] > 0.03]
    up = np.array(fs[-1][2], float)
    tilt = math.degrees(math.acos(max(-1, min(1, up[2] / (np.linalg.norm(up) or 1.0)))))
    return {"path_length": sum(d), "n_bounces": float(sum(1 for a, b in zip(vz, vz[1:]) if a < -0.03 and b > 0.03)),
            "settle_time": t[moving[-1] if moving else 0] - t[0], "max_height": max(q[2] for q in p), "final_tilt_deg": tilt,
            "slid_distance": math.hypot(p[-1][0] - p[0][0], p[-1][1] - p[0][1]), "toppled": float(tilt > 50)}


def test_hand_computed(spark):
    df = frames(
        spark,
        bounce=upright([1.0, 0.6, 0.2, 0.5, 0.2, 0.35, 0.2, 0.2]),
        topple=[(0.1 * i, (0, 0, 0.2), u) for i, u in enumerate([(0, 0, 1), (0.3, 0, 0.9), (0.6, 0, 0.6), (0.9, 0, 0.3), (1, 0, 0.02)])],
        slide=[(1.0 + 0.1 * i, (x, 0, 0.2), (0, 0, 1)) for i, x in enumerate([0.5, 0.6, 0.8])],
        right=[(0, (0, 0, 0), (0, 0, 1)), (0.1, (0, 0, 0), (1, 0, 0))],
        rest=upright([0.2] * 4),
        zero_up=[(0, (0, 0, 0), (0, 0, 1)), (0.1, (0, 0, 0), (0, 0, 0))],
    )
    r = {x["traj"]: x for x in TR.summarize(df, ["traj"]).collect()}
    assert r["bounce"]["n_bounces"] == 2 and r["bounce"]["max_height"] == 1.0 and r["bounce"]["toppled"] == 0
    assert r["topple"]["toppled"] == 1 and r["topple"]["final_tilt_deg"] > 80
    assert r["slide"]["slid_distance"] == pytest.approx(0.3) and r["slide"]["path_length"] == pytest.approx(0.3)
    assert r["slide"]["settle_time"] == pytest.approx(0.2) and r["slide"]["final_tilt_deg"] == 0
    assert r["right"]["final_tilt_deg"] == pytest.approx(90) and r["right"]["toppled"] == 1
    assert r["rest"]["slid_distance"] < 1e-6 and r["rest"]["n_bounces"] == 0 and r["rest"]["settle_time"] == 0
    assert r["zero_up"]["final_tilt_deg"] == pytest.approx(90)


def test_short_trajectory(spark):
    s = TR.summarize(frames(spark, one=upright([1.0]), two=upright([1.0, 1.0])), ["traj"])
    flags = {r["traj"]: r["too_short"] for r in TR.enough_frames(s, "flag").collect()}
    assert flags == {"one": True, "two": False}
    with pytest.raises(Exception, match="at least two frames"):
        TR.enough_frames(s).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_banded_matches_loop(spark, seed):
    rng = np.random.default_rng(seed)
    data = {}
    for j in range(6):
        n = int(rng.integers(2, 30))
        t = np.cumsum(rng.choice([0.1, 0.2, 3.0], n))
        z = rng.choice([0.0, 0.2, 0.5, 1.0], n)
        data[f"t{j}"] = [(t[i], (rng.normal(), rng.normal(), z[i]), rng.normal(size=3)) for i in range(n)]
    df = frames(spark, **data)
    banded = df.withColumn("band", F.floor("t"))            # many bands hold one frame only
    for out in (TR.summarize(df, ["traj"]), TR.summarize(banded, ["traj"], band="band")):
        for r in out.collect():
            for k, v in loop(data[r["traj"]]).items():
                assert r[k] == pytest.approx(v, abs=1e-9), (r["traj"], k)


def test_banded_deltas(spark):
    rng = np.random.default_rng(3)
    data = {"hot": [(0.5 * i, (rng.normal(), 0, rng.choice([0.0, 1.0])), (0, 0, 1)) for i in range(200)], "small": upright([1, 0, 1])}
    df = frames(spark, **data)
    cols = ["traj", "frame_idx", "step", "speed", "vz", "bounce"]
    banded, band = value_bands(df, "t", 10.0), "_band"
    assert banded.select(band).distinct().count() > 5
    assert banded.groupBy("traj", band).count().agg(F.max("count")).first()[0] < 60
    key = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    assert key(TR.frame_deltas(banded, ["traj"], ["frame_idx"], band)) == key(TR.frame_deltas(df, ["traj"], ["frame_idx"]))


def test_null_and_nan_times_give_one_answer_for_one_and_for_many_bands(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, [None, float("nan"), 0.3 * i][min(2, i)] if i < 2 else 0.3 * i, [float(v) for v in rng.normal(size=3)], [0.0, 0.0, 1.0]) for i in range(40)]
    rows += [("b", 0, None, [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]), ("b", 1, float("nan"), [1.0, 0.0, 1.0], [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    order, cols = ["t", "frame_idx"], ["traj", "frame_idx", "step", "speed", "vz", "bounce"]
    deltas, whole = [], []
    for width in (1e9, 2.0, 0.2):
        banded = value_bands(df, "t", width)
        deltas.append(sorted(map(str, TR.frame_deltas(banded, ["traj"], order, "_band").select(*cols).collect())))
        whole.append(sorted([round(v, 9) if isinstance(v, float) else v for v in r] for r in TR.summarize(banded, ["traj"], order, "_band").collect()))
    assert len(deltas[0]) == 42 and deltas[0] == deltas[1] == deltas[2]
    assert str(whole[0]) == str(whole[1]) == str(whole[2])


def test_soft_topple_strict(spark):
    df = spark.createDataFrame([(50.0,), (90.0,)], "tilt double")
    assert TR.soft_topple(df, "tilt").first()["p_topple"] == 0.5


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 9.9, 10.0, 25.0, 99.0)], "v double")
    assert [r["n"] for r in TR.histogram(df, "v", [0, 10, 20]).orderBy("bin").collect()] == [2, 3]


def test_crossover_and_label(spark):
    rows = [("a", 0.0, 40.0), ("a", 1.0, 60.0), ("a", 2.0, 20.0), ("b", 0.0, 10.0), ("b", 1.0, 12.0)]
    c = TR.crossover(spark.createDataFrame(rows, "k string, h double, tilt double"), ["k"], "h", "tilt")
    out = {r["k"]: r for r in c.withColumn("label", TR.classify_label("topple_rate", "crossover")).collect()}
    assert out["a"]["crossover"] == pytest.approx(0.5) and out["a"]["max_slope"] == pytest.approx(40) and out["a"]["label"] == "boundary"
    assert out["b"]["crossover"] is None and out["b"]["label"] == "never"
