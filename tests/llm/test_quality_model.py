"""Quality scores: features against plain counts, the risk, the prior, held-out accuracy and defined results."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probelake.llm import quality_model as M


def texts_of(n, seed, good):
    rng = random.Random(seed)
    words = ["time", "water", "the", "of", "a", "house", "green", "it", "was", "small"]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        out.append(" ".join(w).capitalize() + "." if good else " ".join(x.upper() + rng.choice(["!!", " |", " ##"]) for x in w))
    return out


@pytest.fixture(scope="module")
def corpus(spark, make):
    """900 documents, 70 of 100 good; half of them labelled, all with odd rows at the end."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        rows.append((i, texts_of(1, i, good)[0]))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(2000, None), (2001, ""), (None, "A text without an id."), (3, rows[3][1]), (2002, "word " * 60_000)]
    labels += [(None, 1), (99_999, 0), (2000, None), (labels[0][0], labels[0][1])]
    return make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("text", F.lit("clash")), dict(labels)


def test_features_are_counts():
    text = 'Ab cd. 12\nAb cd. 12\n\n"x" | y'
    x = M.described(pa.array([text, None, "", "é"]))
    assert x.shape == (4, M.WIDTH)
    raw = text.encode()
    pairs = np.zeros(256)
    for a, b in zip(raw, raw[1:]):
        pairs[M.CLASS[a] * 16 + M.CLASS[b]] += 1
    assert np.allclose(x[0, :256], np.sqrt(pairs / len(raw)))
    shape = x[0, 256:]
    assert shape[1] == pytest.approx(1 / 3) and shape[4] == pytest.approx(3 / 9) and shape[5] == pytest.approx(1 / 7)
    assert (x[1] == x[2]).all() and x[1, 256 + 11] == 1 and np.isfinite(x).all()


def test_repeats_of_rows_without_values():
    assert M.repeats(np.array([0, 0, 0, 2]), np.array([1, 1, 2, 1]), 3).tolist() == [pytest.approx(1 / 3), 0, 0]


def test_prior_of_a_mixture():
    rng = np.random.default_rng(1)
    make = lambda n, at: np.concatenate([rng.normal(at, 0.5, (n, 1)), np.zeros((n, M.WIDTH - 1))], axis=1)
    p, u = make(1500, 1.0), np.concatenate([make(1200, 1.0), make(800, -1.5)])
    assert M.estimate_prior(p, u, 1) == pytest.approx(0.6, abs=0.08)
    net = M.fit(p, u, 0.6, 1)
    assert (net.output(make(500, 1.0)) > 0).mean() > 0.9 and (net.output(make(500, -1.5)) > 0).mean() < 0.1


def test_curve_cuts_between_classes():
    a, b = M.logistic_curve(np.array([-3, -2, -1, 2, 3.0, 4]), np.array([0, 0, 0, 1, 1, 1.0]))
    z = np.array([-1, 0.4, 0.6, 2])
    assert (M.sigmoid(a + b * z) >= M.CUT).tolist() == [False, False, True, True]
    assert M.logistic_curve(np.zeros(0), np.zeros(0)) == (pytest.approx(np.log(7 / 3)), 1.0)


def test_held_out_accuracy_and_odd_rows(corpus):
    docs, labels, truth = corpus
    rows = M.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= M.CUT) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(held) > 50 and np.mean(held) > 0.95
    assert 0.55 < rows[0]["prior"] < 0.9
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[2000] == by_id[2001]


def test_held_out_labels_teach_nothing(corpus):
    docs, labels, _ = corpus
    turned = labels.withColumn("quality", F.when(M.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in M.judge(docs.where("doc_id < 400"), x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_nothing_to_learn_from(corpus, make):
    docs, labels, _ = corpus
    assert {r["score"] for r in M.judge(make([(1, "a"), (2, "b")]), labels.limit(0)).collect()} == {0.5}
    assert M.judge(make([]), labels).count() == 0
