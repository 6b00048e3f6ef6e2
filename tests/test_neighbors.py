"""Neighbours and alignment against brute force, with blocks small enough to exercise pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.operators import agreement as AG
from probelake.operators import alignment as AL
from probelake.operators import neighbors as NN


def table(spark, x, **more):
    cols = ", ".join(f"{n} array<double>" for n in more)
    rows = [(i, [float(v) for v in r], *[[float(v) for v in m[i]] for m in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, z array<double>" + (", " + cols if cols else ""))


def brute(q, c, k, skip_self):
    out = []
    for i, a in enumerate(q):
        d = ((a - c) ** 2).sum(1)
        order = sorted((d[j], j) for j in range(len(c)) if not (skip_self and i == j))[:k]
        out.append([j for _, j in order])
    return out


@pytest.mark.parametrize("shape", ["spread", "clusters", "copies"])
@pytest.mark.parametrize("block_rows", [16, 4096])
def test_knn_exact(spark, shape, block_rows):
    rng = np.random.default_rng(1)
    if shape == "spread":
        x = rng.normal(size=(120, 5))
    elif shape == "clusters":
        x = np.concatenate([rng.normal(c, 0.05, size=(40, 2)) for c in (0, 5, 10)])
    else:                                            # a third of all rows are one and the same vector
        x = np.concatenate([np.ones((50, 3)), np.round(rng.normal(size=(100, 3)), 1)])
    got = {}
    for r in NN.knn(table(spark, x), 6, block_rows=block_rows, query_chunk=50).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    want = brute(x, x, 6, True)
    assert len(got) == len(x)
    for i, w in enumerate(want):
        assert [got[i][k] for k in range(1, 7)] == w


def test_knn_join_between_tables(spark):
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(30, 3)), rng.normal(size=(70, 3))
    got = {}
    for r in NN.knn_join(table(spark, q), table(spark, c), 4, block_rows=8).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    assert [[got[i][k] for k in range(1, 5)] for i in range(30)] == brute(q, c, 4, False)


def test_alignment_properties(spark):
    rng = np.random.default_rng(3)
    core = rng.normal(size=(200, 5))
    x, y = core @ rng.normal(size=(5, 12)), core @ rng.normal(size=(5, 9))
    rot, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    df = table(spark, x, y=y, rotated=3.7 * x @ rot, constant=np.ones((200, 4)), shuffled=x[rng.permutation(200)])
    assert AL.mutual_knn(df, "z", "z").first()["alignment"] == 1.0
    assert AL.mutual_knn(df, "z", "shuffled").first()["alignment"] < 30 / 199
    assert AL.mutual_knn(df, "z", "y").first()["alignment"] > 0.3
    assert AL.linear_cka(df, "z", "rotated", 12).first()["cka"] == pytest.approx(1.0)
    assert AL.linear_cka(df, "z", "constant", 12).first()["cka"] == 0.0
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.norm(xc.T @ yc) ** 2 / (np.linalg.norm(xc.T @ xc) * np.linalg.norm(yc.T @ yc))
    assert AL.linear_cka(df, "z", "y", 12).first()["cka"] == pytest.approx(want)
    v = x.var(0)
    assert AL.participation_ratio(df, "z").first()["participation_ratio"] == pytest.approx(v.sum() ** 2 / ((v ** 2).sum() + 1e-12))
    assert AL.participation_ratio(df, "constant").first()["participation_ratio"] == 0


def test_code_statistics(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-1, 2, 512)
    relabel = {-1: 0, 0: 1, 1: -1}
    rows = [(int(v), relabel[int(v)], int(w), [int(v), int(w)]) for v, w in zip(a, rng.integers(-1, 2, 512))]
    df = spark.createDataFrame(rows, "a int, b int, c int, pair array<int>")
    best = AG.trit_agreement(df, "a", "b").first()
    assert best["agreement"] == 1.0 and best["relabeling"] == "0,1,-1"
    null = AG.trit_agreement_null(df, "a", "c", draws=300).first()
    perm = [max(np.mean(np.vectorize(dict(zip((-1, 0, 1), p)).get)(a) == rng.permutation([r[2] for r in rows])) for p in AG.RELABELINGS)
            for _ in range(300)]
    assert null["null_mean"] == pytest.approx(np.mean(perm), abs=0.01) and null["null_p95"] == pytest.approx(np.quantile(perm, 0.95), abs=0.015)
    p = np.bincount(a + 1) / 512
    assert AG.mutual_information(df, "a", "b").first()["mi"] == pytest.approx(-(p * np.log(p)).sum())
    assert AG.adjusted_rand(df, "pair", "pair").first()["ari"] == pytest.approx(1.0)
    assert abs(AG.adjusted_rand(df, "a", "c").first()["ari"]) < 0.05
    assert AG.adjusted_rand(df.withColumn("one", F.lit(1)), "one", "one").first()["ari"] == 1.0
    with pytest.raises(Exception, match="code values"):
        AG.trit_agreement(df.withColumn("a", F.lit(2)), "a", "b").collect()


def test_search_is_folded_to_distinct_vectors(spark):
    """Copies are searched once: 40 rows of 4 vectors make 4 candidates and 4 queries, and the blocks hold no copy."""
    x = np.repeat(np.arange(4.0)[:, None] * [1.0, 2.0], 10, axis=0)
    rows = NN._rows(table(spark, x), "id", "z", ())
    assert NN._search(rows, rows, 3, 1, 16, 16).count() == 4
    near = NN.knn(table(spark, x), 12)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    want = [sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(40) if j != i)[:12] for i in range(40)]
    assert [[n for _, n in sorted(got[i])] for i in range(40)] == [[j for _, j in w] for w in want]


def test_ties_on_a_grid(spark):
    """Many equal distances between distinct vectors and copies, over several blocks."""
    x = np.round(np.random.default_rng(1).normal(size=(400, 2)), 1)
    got = {}
    for r in NN.knn(table(spark, x), 6, block_rows=64, query_chunk=50).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    for i, a in enumerate(x):
        d = ((a - x) ** 2).sum(1)
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:6]
        assert [got[i][k] for k in range(1, 7)] == [j for _, j in want]


def test_vector_without_distance_hides_no_neighbor(spark):
    x = np.array([[0.0], [1.0], [float("nan")], [3.0]])
    got = {(r["id"], r["neighbor"]) for r in NN.knn(table(spark, x), 1).collect()}
    assert got == {(0, 1), (1, 0), (3, 1)}
