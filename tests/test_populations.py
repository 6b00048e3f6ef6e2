"""One search for several populations, kernel alignment of many runs, roll-ups of codes, terciles of many columns, reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.operators import agreement as AG
from probelake.operators import alignment as AL
from probelake.operators import neighbors as NN
from probelake.operators import regressors as RG
from probelake.operators import reports as RP


@pytest.mark.parametrize("block_rows", [16, 4096])
@pytest.mark.parametrize("shape", ["spread", "clusters", "copies"])
def test_populations_are_searched_among_their_own(spark, shape, block_rows):
    rng = np.random.default_rng(3)
    x = {"spread": lambda: rng.normal(size=(150, 4)), "clusters": lambda: np.concatenate([rng.normal(c, 0.05, size=(50, 2)) for c in (0, 5, 10)]),
         "copies": lambda: np.concatenate([np.ones((60, 3)), np.round(rng.normal(size=(90, 3)), 1)])}[shape]()
    rows = [(i, v.tolist(), i % 5 == 0 or i > 140, None if i < 100 else i % 2 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, z array<double>, test boolean, odd boolean").withColumn("all", F.lit(True))
    flags = {"all": [True] * 150, "test": [r[2] for r in rows], "odd": [bool(r[3]) for r in rows]}
    got = {}
    for r in NN.knn(df, 6, populations=["all", "test", "odd"], block_rows=block_rows, query_chunk=40).collect():
        got.setdefault((r["population"], r["id"]), {})[r["rank"]] = r["neighbor"]
    assert {k for k in got} == {(p, i) for p, f in flags.items() for i in range(150) if f[i]}
    for (p, i), ranks in got.items():
        d = ((x[i] - x) ** 2).sum(1)
        want = [j for _, j in sorted((d[j], j) for j in range(150) if flags[p][j] and j != i)[:6]]
        assert [ranks[k] for k in range(1, 7)] == want, (p, i)


def cka(a, b):
    a, b = a - a.mean(0), b - b.mean(0)
    return ((a.T @ b) ** 2).sum() / np.sqrt(((a.T @ a) ** 2).sum() * ((b.T @ b) ** 2).sum())


def long_form(spark, runs):
    rows = [(r, i, v.tolist()) for r, z in runs.items() for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "run_id string, id bigint, z array<double>").repartition(5)


@pytest.mark.parametrize("panel", [8, 2048])
def test_kernel_alignment_of_all_pairs(spark, panel):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(90, 6)) + 1e6  # a large offset must not eat the digits
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    runs = {"a": base, "b": base @ q * 3.7, "c": rng.normal(size=(90, 3)), "d": base[:, :4] + rng.normal(size=(90, 4)), "e": np.ones((90, 2))}
    names = sorted(runs)
    pairs = spark.createDataFrame([(x, y) for x in names for y in names if x != y], "run_a string, run_b string")
    got = {(r["run_a"], r["run_b"]): r["cka"] for r in AL.cka_by_pair(long_form(spark, runs), pairs, panel_columns=panel).collect()}
    assert len(got) == 20 and got["a", "b"] == pytest.approx(1.0, abs=1e-6)
    for (x, y), v in got.items():
        assert v == pytest.approx(0.0 if "e" in (x, y) else cka(runs[x], runs[y]), abs=1e-6), (x, y)


def test_runs_of_a_pair_must_list_the_same_scenes(spark):
    z = np.arange(20.0).reshape(10, 2)
    df = long_form(spark, {"a": z, "b": z[:9], "c": z})
    ok = spark.createDataFrame([("a", "c")], "run_a string, run_b string")
    assert AL.cka_by_pair(df, ok).first()["cka"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="different scenes"):
        AL.cka_by_pair(df, spark.createDataFrame([("a", "b")], "run_a string, run_b string")).collect()
    with pytest.raises(Exception, match="twice"):
        AL.cka_by_pair(df.union(df.where("run_id = 'a'")), ok).collect()


def rand(a, b):
    same = lambda x, y: sum(1 for i in range(len(x)) for j in range(i) if x[i] == x[j] and y[i] == y[j])
    n = len(a) * (len(a) - 1) / 2
    both, pa, pb = same(a, b), same(a, a), same(b, b)
    return (both - pa * pb / n) / ((pa + pb) / 2 - pa * pb / n)


@pytest.fixture(scope="module")
def codes(spark):
    rng = np.random.default_rng(6)
    c = {0: rng.integers(-1, 2, (60, 4)), 1: rng.integers(-1, 2, (60, 4))}
    c[2] = np.where(rng.random((60, 4)) < 0.2, 0, -c[0])
    factor = rng.normal(size=60)
    rows = [(r, i, v.tolist(), int(i % 3), float(factor[i]) if i else None) for r, z in c.items() for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "run int, id int, code array<int>, label int, grip double"), c, factor


def test_rand_index_of_all_widths_from_one_table(codes):
    df, c, _ = codes
    cells = RP.code_cells(df, "id", "run", "code")
    got = {(r["item"], r["width"]): r["ari"] for r in AG.adjusted_rand_by_width(cells, (1, 2, 4), ["item"]).collect()}
    assert set(got) == {(i, w) for i in ("0|1", "0|2", "1|2") for w in (1, 2, 4)}
    for (item, w), v in got.items():
        a, b = (list(map(tuple, c[int(k)][:, :w])) for k in item.split("|"))
        assert v == pytest.approx(rand(a, b)), (item, w)


def test_code_numbers_hold_39_digits(spark):
    code = [-1, 0, 1] * 13
    df = spark.createDataFrame([(code,), ([1] * 40,)], "code array<int>")
    n = df.where("size(code) = 39").select(AG.code_number("code")).first()[0]
    assert n == sum((c + 1) * 3 ** i for i, c in enumerate(code))
    back = df.where("size(code) = 39").select(RP.digits_of(AG.code_number("code"), 39)).first()[0]
    assert back == code
    with pytest.raises(Exception, match="39"):
        df.select(AG.code_number("code")).collect()


def test_code_report_rows(codes):
    df, c, factor = codes
    rows = RP.code_report(df, "id", "run", "code", ["label"], ["grip"], width=4, draws=20).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["measure"], []).append(r)
    assert {k: len(v) for k, v in kinds.items()} == {"agreement": 12, "ari_1": 3, "ari_2": 3, "ari_4": 3, "mi_label": 12, "mi_grip": 12, "minus_share": 12, "zero_share": 12, "plus_share": 12}
    assert all(r["null_p95"] is not None for r in kinds["agreement"]) and all(0 <= r["value"] <= 1 for r in kinds["zero_share"])
    cuts = np.quantile(factor[1:], [1 / 3, 2 / 3])
    label = (factor > cuts[0]).astype(int) + (factor > cuts[1])
    for r in kinds["mi_grip"]:
        digit = c[int(r["item"])][1:, r["entry"]]
        mi = sum((p := np.mean((digit == d) & (label[1:] == v))) and p * np.log(p / (np.mean(digit == d) * np.mean(label[1:] == v))) for d in (-1, 0, 1) for v in (0, 1, 2))
        assert r["value"] == pytest.approx(mi, abs=1e-9)


def test_terciles_of_many_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), None if i % 3 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {(r["id"], r["factor"]): r["label"] for r in AG.tercile_labels(df, "id", ["a", "b", "c"]).collect()}
    for at, name in enumerate("abc", 1):
        v = [r[at] for r in rows if r[at] is not None]
        q = np.quantile(v, [1 / 3, 2 / 3])
        for r in rows:
            assert got.get((r[0], name)) == (None if r[at] is None else int(r[at] > q[0]) + int(r[at] > q[1]))


def test_alignment_report_leaves_out_collapsed_runs(spark):
    rng = np.random.default_rng(9)
    z = {0: rng.normal(size=(60, 4)), 1: rng.normal(size=(60, 4)), 2: np.outer(rng.normal(size=60), [1.0, 0.01, 0.0, 0.0]), 3: rng.normal(size=(60, 4)), 4: rng.normal(size=(60, 4))}
    latents = spark.createDataFrame([(r, i, v.tolist()) for r, m in z.items() for i, v in enumerate(m)], "run_id bigint, id bigint, z array<double>")
    registry = spark.createDataFrame([(0, "a", "trained", 0), (1, "a", "trained", 1), (2, "a", "trained", 2), (3, "a", "untrained", 0), (4, "a", "untrained", 1)], "run_id bigint, arm string, kind string, seed int")
    flagged = latents.withColumns({"all": F.lit(True), "test": F.col("id") % 2 == 0})
    near = None
    for r in z:
        one = NN.knn(flagged.where(F.col("run_id") == r), 5, populations=["all", "test"]).withColumn("run_id", F.lit(r).cast("bigint"))
        near = one if near is None else near.unionByName(one)
    rows = {r["population"]: r for r in RP.alignment_report(near, registry, 5, latents=latents, floor=2.0).collect()}
    assert set(rows) == {"all", "test"} and rows["all"]["n_dropped"] == 1
    assert rows["all"]["trained_cka"] == pytest.approx(cka(z[0], z[1]), abs=1e-9) and rows["all"]["untrained_cka"] == pytest.approx(cka(z[3], z[4]), abs=1e-9)
    assert rows["test"]["trained_cka"] is None and rows["all"]["self_overlap"] == 1.0 and rows["test"]["trained"] > rows["all"]["trained"] / 3

    def overlap(a, b, ids):
        lists = lambda m: [{ids[j] for j in np.argsort(((m[ids] - m[i]) ** 2).sum(1))[1:6]} for i in ids]
        return np.mean([len(p & q) / 5 for p, q in zip(lists(a), lists(b))])

    assert rows["all"]["trained"] == pytest.approx(overlap(z[0], z[1], np.arange(60)))
    assert rows["test"]["untrained"] == pytest.approx(overlap(z[3], z[4], np.arange(0, 60, 2)))


def test_top_fields_of_an_arm(spark):
    rng = np.random.default_rng(10)
    s, e = rng.normal(size=200), rng.normal(size=200)
    noise = rng.normal(size=(200, 8))
    y = np.stack([s + 0.1 * noise[:, 0]] + [k * 0.2 * e + 0.3 * noise[:, k] for k in range(1, 8)], 1)
    rows = [(i, "test" if i % 4 == 0 else "train", [float(s[i])], [float(s[i]), float(e[i])], y[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, split string, shape array<double>, both array<double>, y array<double>")
    out = {r["arm"]: r for r in RG.oracle_report(df, {"shape": ("shape", 1), "shape_essence": ("both", 2)}, "y", regressors=("ridge-linear", "ridge-quad")).collect()}
    top = out["shape_essence"]["top_fields"]
    assert [t["rank"] for t in top] == [1, 2, 3, 4, 5, 6] and out["shape"]["top_fields"] == [] and out["shape"]["contribution"] == 0
    assert [t["delta"] for t in top] == sorted((t["delta"] for t in top), reverse=True) and 0 not in {t["pos"] for t in top} and top[0]["pos"] in (6, 7)
