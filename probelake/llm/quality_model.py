"""Quality scores from positive and unlabelled texts.

A text becomes a row of ``WIDTH`` numbers: how often each pair of character classes follows each other, and shares of
repeated lines, words and word triples, of capitals, of sentence ends and of short words. Counting is over whole texts
and works on a batch at a time. A small network is fitted by the non-negative unbiased risk: with trusted positives P,
unlabelled texts U and the class prior c, the risk of the negatives is that of U minus c times that of P taken as
negatives; when a mini-batch makes it negative, its gradient is turned around. The prior is estimated with a first
network that tells P from U: the largest scores hold positives only, so the share of U above a threshold over the share
of P above it comes down to the prior where the threshold is high; the bound by the sampling error is kept.

A logistic curve over the output, fitted on at most ``CURVE_DOCS`` labelled documents that train nothing else, turns it
into a score; the cut that makes the fewest mistakes among them, both classes counting alike, lies at ``CUT``.

Bounds: ``POSITIVE_DOCS``, ``UNLABELLED_DOCS`` and ``CURVE_DOCS`` documents, those of the smallest hash of ``doc_id``; only
their numbers reach the driver. All documents are scored.

Defined results: a null text counts as empty; an empty text has a score like any other; a document with several labels is
positive if all are 1; null labels and labels of unknown documents teach nothing; documents of one ``doc_id`` stand for
one document in the sample. Without positives or unlabelled texts every score is the share of positive labels, or 0.5.
Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.batches import by_bytes

POSITIVE_DOCS, UNLABELLED_DOCS, CURVE_DOCS = 6_000, 12_000, 3_000
CUT = 0.7  # score from which a document is predicted to be good
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 30, 256, 3e-3, 1e-3
PRIOR_RANGE = (0.02, 0.98)
TEXT_BYTES = 2_000_000  # of text turned into numbers at a time

# classes of bytes: every other byte is class 0
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b"\r\x0b\x0c", b".", b"!?", b",;:", b"'\"`", b"#*$%&|<>", b"()[]{}",
           b"-_/\\+=~^@", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
N_CLASSES = 16
CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(CLASSES, 1):
    CLASS[list(_bytes)] = _k
SHAPE = 12  # numbers beside the pairs of classes
WIDTH = N_CLASSES * N_CLASSES + SHAPE


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def repeats(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Share of the values of each row that occurred before in it."""
    pairs = np.unique(np.stack([row, value]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    n = np.bincount(row, minlength=n_rows)
    return 1 - np.bincount(pairs[0], minlength=n_rows) / np.maximum(n, 1) * (n > 0) - (n == 0)


def described(texts: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    code = CLASS[np.frombuffer("".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int64)
    row = np.repeat(np.arange(n), length)
    inside = row[1:] == row[:-1]
    pair = (row[1:] * N_CLASSES + code[:-1]) * N_CLASSES + code[1:]
    out = np.zeros((n, WIDTH))
    counted = np.bincount(pair[inside], minlength=n * N_CLASSES ** 2).reshape(n, -1)
    out[:, :N_CLASSES ** 2] = np.sqrt(counted / np.maximum(length, 1)[:, None])
    shape = out[:, N_CLASSES ** 2:]
    shape[:, 0] = np.log1p(length)
    lines = pc.split_pattern(texts, "\n")
    line, of = pc.dictionary_encode(lines.flatten()), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    which = line.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = (pc.binary_length(line.dictionary).to_numpy(zero_copy_only=False) > 0)[which]
    n_lines = np.maximum(np.bincount(of[filled], minlength=n), 1)
    shape[:, 1] = repeats(of[filled], which[filled], n)
    shape[:, 2] = np.log1p(length / n_lines)
    ends = pc.match_substring_regex(line.dictionary, "[.!?][\"')]*\\s*$").to_numpy(zero_copy_only=False)[which]
    shape[:, 3] = np.bincount(of[filled & ends], minlength=n) / n_lines
    words = pc.split_pattern_regex(texts, "[\\x20\\x09-\\x0D]+")
    word, of = pc.dictionary_encode(words.flatten()), pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    which = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(word.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[which]
    of, which, size = of[size > 0], which[size > 0], size[size > 0]
    n_words = np.maximum(np.bincount(of, minlength=n), 1)
    shape[:, 4] = repeats(of, which, n)
    k = max(len(word.dictionary), 1)
    if len(of) > 2:
        same = of[2:] == of[:-2]
        two = np.unique(which[:-1] * k + which[1:], return_inverse=True)[1]
        shape[:, 5] = repeats(of[2:][same], (two[:-1] * k + which[2:])[same], n)
    shape[:, 6] = np.bincount(of, weights=size, minlength=n) / n_words / 10
    shape[:, 7] = np.sqrt(np.maximum(np.bincount(of, weights=size ** 2, minlength=n) / n_words - (10 * shape[:, 6]) ** 2, 0)) / 10
    shape[:, 8] = np.bincount(of[size <= 3], minlength=n) / n_words
    shape[:, 9] = np.bincount(of[size >= 20], minlength=n) / n_words
    shape[:, 10] = np.log1p(n_words)
    shape[:, 11] = length == 0
    return out


class Network:
    """One hidden layer over centred numbers."""

    def __init__(self, x: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        self.p = [rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def output(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.maximum(self.inputs(x) @ w + b, 0) @ u + c[0]

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step along the loss's slope by the output of each row."""
        w, b, u, _ = self.p
        z = self.inputs(x)
        h = np.maximum(z @ w + b, 0)
        back = np.outer(slope, u) * (h > 0)
        self.t += 1
        for i, g in enumerate([z.T @ back + DECAY * w, back.sum(0), h.T @ slope + DECAY * u, np.array([slope.sum()])]):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - RATE * (self.m[i] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[i] / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def batches_of(n_p: int, n_u: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mini-batches of both samples; the smaller sample is gone through more often."""
    steps = -(-max(n_p, n_u) // BATCH)
    order = [np.concatenate([rng.permutation(n) for _ in range(-(-steps * min(BATCH, n) // n))]) for n in (n_p, n_u)]
    for s in range(steps):
        yield tuple(o[s * min(BATCH, n):(s + 1) * min(BATCH, n)] for o, n in zip(order, (n_p, n_u)))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, epochs: int = EPOCHS) -> Network:
    """A network by the non-negative unbiased risk with the logistic loss; without a prior one that tells ``p`` from ``u``."""
    rng, net = np.random.default_rng(seed), Network(u, seed)
    for _ in range(epochs):
        for i, j in batches_of(len(p), len(u), rng):
            x = np.concatenate([p[i], u[j]])
            z = net.output(x)
            zp, zu = z[:len(i)], z[len(i):]
            as_negative = sigmoid(z)  # slope of log(1 + e^z), the loss of a negative
            up, uu = as_negative[:len(i)] / len(i), as_negative[len(i):] / len(j)
            if prior is None:
                net.step(x, np.concatenate([up - 1 / len(i), uu]))
                continue
            negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negatives >= 0:
                net.step(x, np.concatenate([prior * (up - 1 / len(i)) - prior * up, uu]))
            else:  # overfitted negatives: walk back on their risk alone
                net.step(x, np.concatenate([prior * up, -uu]))
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int) -> float:
    """Share of positives among ``u``: the least ratio of shares above a threshold, with the sampling error of either share."""
    half_p, half_u = len(p) // 2, len(u) // 2
    if not half_p or not half_u:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(p), rng.permutation(u)
    ratios = []
    for a, b in (((p[:half_p], u[:half_u]), (p[half_p:], u[half_u:])), ((p[half_p:], u[half_u:]), (p[:half_p], u[:half_u]))):
        net = fit(*a, None, seed, epochs=EPOCHS // 3)
        zp, zu = np.sort(net.output(b[0])), np.sort(net.output(b[1]))
        at = np.quantile(zp, np.linspace(0, 0.95, 96))
        above_p = 1 - np.searchsorted(zp, at) / len(zp)
        above_u = 1 - np.searchsorted(zu, at) / len(zu)
        error = np.sqrt(np.log(20) / (2 * len(zp))) + np.sqrt(np.log(20) / (2 * len(zu)))
        best = np.argmin((above_u + error) / np.maximum(above_p, 1e-9))
        ratios.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(ratios), *PRIOR_RANGE))


def logistic_curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope; the score is ``CUT`` where mistakes in both classes are fewest, in shares of the class."""
    if not len(y) or y.min() == y.max():
        return float(np.log(CUT / (1 - CUT))), 1.0
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    lost_good = np.concatenate([[0], np.cumsum(ys)]) / ys.sum()
    kept_bad = 1 - np.concatenate([[0], np.cumsum(1 - ys)]) / (1 - ys).sum()
    k = int(np.argmin(lost_good + kept_bad))
    cut = zs[0] - 1 if k == 0 else zs[-1] + 1 if k == len(zs) else (zs[k - 1] + zs[k]) / 2
    slope = 1.0
    for _ in range(30):  # Newton steps for the slope through (cut, CUT), held by a weak prior
        q = sigmoid(np.log(CUT / (1 - CUT)) + slope * (z - cut))
        g = ((y - q) * (z - cut)).sum() - (slope - 1)
        slope = max(slope + g / ((q * (1 - q) * (z - cut) ** 2).sum() + 1), 0.05)
    return float(np.log(CUT / (1 - CUT)) - slope * cut), float(slope)


class QualityModel:
    """A fitted network with its score curve."""

    def __init__(self, p: np.ndarray, u: np.ndarray, curve_x: np.ndarray, curve_y: np.ndarray, seed: int = 1):
        self.net, self.prior, self.curve = None, None, (0.0, 1.0)
        if len(p) and len(u):
            self.prior = estimate_prior(p, u, seed)
            self.net = fit(p, u, self.prior, seed)
            self.net.m = self.net.v = None
            self.curve = logistic_curve(self.net.output(curve_x), curve_y)
        elif len(curve_y):
            share = np.clip(curve_y.mean(), 1e-6, 1 - 1e-6)
            self.curve = float(np.log(share / (1 - share))), 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] + self.curve[1] * (self.net.output(x) if self.net else np.zeros(len(x))))


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``x`` of ``docs`` (``doc_id``, ``text``), one row for each id (of several texts, the one of the smallest hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, size=TEXT_BYTES):
            x = described(batch.column("text"))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, WIDTH, dtype=np.int32), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), flat], ["doc_id", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {kind}, h bigint, x array<float>")
    return rows.groupBy("doc_id").agg(F.min_by("x", "h").alias("x"))


def least_hashed(ids: DataFrame, most: int) -> DataFrame:
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample(docs: DataFrame, ids: DataFrame) -> tuple[list, np.ndarray]:
    """The ids found and their rows of numbers; ``ids`` are few (see the bounds) and broadcast."""
    rows = describe(docs.join(F.broadcast(ids), "doc_id", "left_semi")).orderBy("doc_id").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
    return rows.column("doc_id").to_pylist(), x


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> QualityModel:
    """A model of ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``target``), both without held-out documents."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).alias("y"))
    curve_ids = least_hashed(known.select("doc_id"), CURVE_DOCS).join(known, "doc_id")
    marks = {r["doc_id"]: r["y"] for r in curve_ids.collect()}  # at most CURVE_DOCS; every fourth of a small set
    by_hash = sorted(marks)[::2] if len(marks) < CURVE_DOCS else sorted(marks)
    curve = known.sparkSession.createDataFrame([(d,) for d in by_hash], docs.select("doc_id").schema)
    trusted = known.where("y = 1").select("doc_id").join(F.broadcast(curve), "doc_id", "left_anti")
    _, p = sample(docs, least_hashed(trusted, POSITIVE_DOCS))
    _, u = sample(docs, least_hashed(docs.select("doc_id"), UNLABELLED_DOCS))
    found, x = sample(docs, curve)
    return QualityModel(p, u, x, np.array([marks[d] for d in found], float))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` of every row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, size=TEXT_BYTES):
            s = shared.value.score(described(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """Train on documents and labels whose remainder (checksum of the id, mod 4) is not 2, score all.

    Adds ``held_out`` (remainder 2: neither text nor label of such a document is learned from) and ``prior``.
    """
    learn = remainder(F.col("doc_id")) != 2
    model = train(docs.where(learn), labels.where(learn), target)
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.lit(model.prior).cast("double").alias("prior"))
