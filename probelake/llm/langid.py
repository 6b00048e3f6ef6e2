"""Language identification by interpolated Kneser-Ney character models.

One character model per language is estimated from n-gram counts over all training texts. Counting is distributed:
a task counts the distinct words of a batch first and then the n-grams of those words, Spark adds the counts. Every
n-gram is kept. Spark derives the counts of the lower orders and of the counts one and two (discounts) from the whole
table; each order is then dealt by the hash of the context, so that one task has all followers of its contexts and
estimates them. A model is a set of sorted arrays of 64-bit n-gram hashes with one row of probabilities for all
languages, and sorted context hashes with the backoff weights, in files of about ``PART_BYTES`` in the shared folder.
Tasks memory-map these files; the driver holds their names and the counts of counts only.

A text is scored by the cross-entropy per character of its lower-cased letter runs, each run between word
boundaries; the language with the lowest one is predicted (ties: the first in name order). A logistic curve over
the margin to the second language and a limit on the cross-entropy of each language, both fitted on at most
``CALIBRATION_DOCS`` labelled documents kept out of the counts, give the score and the rejection.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; texts whose label is
null do not train; with no training text at all every text is ``und``. Rows without ``doc_id`` are scored and
never train. Other columns are ignored, whatever their names; an empty table gives an empty result; texts are
counted and scored whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.batches import by_bytes
from probelake.llm.tokenbin import store
from probelake.session import durable, scratch_path, small

ORDER = 4
PART_BYTES = 8_000_000  # of one model file
CALIBRATION_DOCS, LIMIT_QUANTILE = 2_000, 0.995
ONE_ASIDE_IN, LEAST_ASIDE = 4, 20  # at most so large a share of the documents, and none of a language with fewer documents
LOADED_BYTES = 64_000_000  # of model files that a worker holds when it cannot map them
UNKNOWN = "und"
SPACE = r"[\x20\x09-\x0D]+"
RADIX = np.uint64(0x9E3779B97F4A7C15)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


class Grams:
    """The n-grams of a list of words: one row per scored character, with the word it belongs to."""

    def __init__(self, words: list[str], order: int = ORDER):
        code = np.frombuffer(("\n".join(words) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.cumsum(code == 10) - (code == 10)
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        letter = np.zeros(int(code.max(initial=0)) + 1, bool)
        letter[[c for c in seen if chr(c).isalpha()]] = True
        is_letter = letter[code]
        code = np.where(is_letter, code, 0)
        at = np.arange(len(code))
        last = np.maximum.accumulate(np.where(is_letter, -1, at))  # last boundary up to here
        before = np.concatenate([[-1], last[:-1]])  # last boundary before here
        run = at - before - 1  # letters between that boundary and here
        use = np.flatnonzero(is_letter | (run > 0))
        self.word = word[use]
        self.chars = np.zeros((len(use), order), np.int64)  # oldest first
        for j in range(order):
            self.chars[:, order - 1 - j] = np.where(run[use] >= j, code[np.maximum(use - j, 0)], 0)

    def __len__(self) -> int:
        return len(self.word)


def hashed(chars: np.ndarray) -> np.ndarray:
    """64-bit hash of rows of characters, oldest first."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(chars), np.uint64)
        for j in range(chars.shape[1]):
            h = (h + chars[:, j].astype(np.uint64) + np.uint64(1)) * RADIX
            h ^= h >> np.uint64(29)
        return h


def distinct_words(batch_text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch, and for every occurrence its word and its row."""
    lists = pc.split_pattern_regex(pc.fill_null(batch_text, ""), SPACE)
    coded = pc.dictionary_encode(lists.flatten())
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all rows of ``docs`` (``lang`` not null, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words, which, row = distinct_words(batch.column("text"))
            if not words:
                continue
            langs = pc.dictionary_encode(batch.column("lang"))
            lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, times = np.unique(lang_of[row] * len(words) + which, return_counts=True)
            grams = Grams(words, order)
            keys = hashed(grams.chars)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = pairs // len(words) == k
                weight = np.zeros(len(words), np.int64)
                weight[pairs[mine] % len(words)] = times[mine]
                rows = np.flatnonzero(weight[grams.word])
                if not len(rows):
                    continue
                _, first, back = np.unique(keys[rows], return_index=True, return_inverse=True)
                n = np.bincount(back, weights=weight[grams.word[rows]]).astype(np.int64)
                text = ["".join(map(chr, c)) for c in grams.chars[rows[first]].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text)), pa.array(text), pa.array(n)], ["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def characters(grams: list[str], order: int) -> np.ndarray:
    """Rows of the characters of n-grams of one length."""
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, order)


def discounts(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    d = np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
    return np.clip(d, 0.1, 0.9)


class HashTable:
    """Sorted 64-bit hashes with a row of values for each, in 2 ** ``bits`` parts by leading bits of the context's hash.

    A part is a pair of arrays, the name of a file in ``folder``, or None (empty).
    """

    def __init__(self, parts: list, width: int, bits: int = 0, folder: str = ""):
        self.parts, self.width, self.bits, self.folder = parts, width, bits, folder
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def part(self, i: int):
        if not isinstance(self.parts[i], str):
            return self.parts[i]
        if i in self.opened:
            self.opened[i] = self.opened.pop(i)  # the last used stands last
        else:
            files, path = store(self.folder)
            name = f"{path}/{self.parts[i]}"
            if isinstance(files, fs.LocalFileSystem):
                raw = np.memmap(name, np.uint8, "r")
            else:
                with files.open_input_file(name) as f:
                    raw = np.frombuffer(f.read(), np.uint8)
                while self.opened and sum(k.nbytes + v.nbytes for k, v in self.opened.values()) + len(raw) > LOADED_BYTES:
                    del self.opened[next(iter(self.opened))]
            n = len(raw) // (8 + 4 * self.width)
            self.opened[i] = raw[:8 * n].view(np.uint64), raw[8 * n:].view(np.float32).reshape(n, self.width)
        return self.opened[i]

    def find(self, keys: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (1 for absent ones)."""
        hit, values = np.zeros(len(keys), bool), np.ones((len(keys), self.width), np.float32)
        which = part_of(contexts, self.bits)
        rows = np.argsort(which, kind="stable")
        present, first = np.unique(which[rows], return_index=True)
        for i, mine in zip(present, np.split(rows, first[1:])):
            stored = self.part(int(i))
            if stored is None:
                continue
            at = np.minimum(np.searchsorted(stored[0], keys[mine]), len(stored[0]) - 1)
            ok = stored[0][at] == keys[mine]
            hit[mine] = ok
            values[mine[ok]] = stored[1][at[ok]]
        return hit, values


def part_of(contexts: np.ndarray, bits: int) -> np.ndarray:
    return (contexts >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(contexts), np.int64)


def estimate(chars: np.ndarray, lang: np.ndarray, n: np.ndarray, discount: np.ndarray, lower: Callable[[np.ndarray], np.ndarray]) -> tuple:
    """Hashes and probabilities of the n-grams, hashes and backoff weights of their contexts.

    The rows hold all followers of every context among them. ``lower`` gives the next lower order's probabilities.
    """
    keys, first, back = np.unique(hashed(chars), return_index=True, return_inverse=True)
    chars = chars[first]
    c = np.zeros((len(keys), len(discount)))
    np.add.at(c, (back, lang), n)
    ctx_keys, back = np.unique(hashed(chars[:, :-1]), return_inverse=True)
    total, followers = np.zeros((len(ctx_keys), len(discount))), np.zeros((len(ctx_keys), len(discount)))
    np.add.at(total, back, c)
    np.add.at(followers, back, c > 0)
    safe = np.maximum(total, 1)
    backoff = np.where(total > 0, discount * followers / safe, 1.0)
    p = np.maximum(c - discount, 0) / safe[back] + backoff[back] * lower(chars[:, 1:])
    return keys, p.astype(np.float32), ctx_keys, backoff.astype(np.float32)


class CharacterModels:
    """Interpolated Kneser-Ney models of several languages in shared sorted arrays."""

    def __init__(self, counts: pd.DataFrame | None = None, order: int = ORDER, langs: list[str] = ()):
        self.langs = sorted(langs if counts is None else counts["lang"].unique())
        self.order = order
        self.grams: list[HashTable] = []  # by order 1..n: probabilities
        self.contexts: list[HashTable] = []  # backoff weights
        self.uniform = 1.0
        self.limits = np.full(len(self.langs), np.inf)
        self.curve = (0.0, 1.0)
        if counts is None or not self.langs:
            return
        # counts of every order: the highest as seen, lower ones by the number of distinct characters in front
        number = {x: i for i, x in enumerate(self.langs)}
        levels = [(characters(counts["gram"].tolist(), order), counts["lang"].map(number).to_numpy(np.int64), counts["n"].to_numpy(np.int64))]
        for _ in range(order - 1):
            chars, lang, _ = levels[-1]
            _, first, n = np.unique(np.stack([lang.astype(np.uint64), hashed(chars[:, 1:])]), axis=1, return_index=True, return_counts=True)
            levels.append((chars[first, 1:], lang[first], n))
        self.uniform = 1.0 / (len(np.unique(levels[-1][0])) + 1)
        for k, (chars, lang, n) in enumerate(reversed(levels), 1):
            d = discounts(*(np.bincount(lang[n == v], minlength=len(self.langs)) for v in (1, 2)))
            keys, p, ctx_keys, backoff = estimate(chars, lang, n, d, self.lower(k))
            self.grams.append(HashTable([(keys, p)], len(self.langs)))
            self.contexts.append(HashTable([(ctx_keys, backoff)], len(self.langs)))

    def lower(self, k: int) -> Callable[[np.ndarray], np.ndarray]:
        """Probabilities of n-grams one shorter than ``k``, all of which are in the tables."""
        if k == 1:
            return lambda chars: np.full((len(chars), len(self.langs)), self.uniform)
        return lambda chars: self.grams[k - 2].find(hashed(chars), hashed(chars[:, :-1]))[1]

    def log_probability(self, chars: np.ndarray) -> np.ndarray:
        """Natural log probability of the last character of each row in every language."""
        out = np.zeros((len(chars), len(self.langs)), np.float32)
        open_rows, factor = np.arange(len(chars)), np.ones((len(chars), len(self.langs)), np.float32)
        for k in range(self.order, 0, -1):
            if not len(open_rows):
                return out
            rows = chars[open_rows][:, self.order - k:]
            ctx = hashed(rows[:, :-1])
            hit, p = self.grams[k - 1].find(hashed(rows), ctx)
            out[open_rows[hit]] = np.log(factor[hit] * p[hit])
            open_rows, factor, ctx = open_rows[~hit], factor[~hit], ctx[~hit]
            factor = factor * self.contexts[k - 1].find(ctx, ctx)[1]
        out[open_rows] = np.log(factor * self.uniform)
        return out

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats per scored character of each text in every language, and the number of scored characters."""
        words, which, row = distinct_words(texts)
        n_rows, n_langs = len(texts), len(self.langs)
        sums, n = np.zeros((n_rows, n_langs)), np.zeros(n_rows)
        if words and n_langs:
            grams = Grams(words, self.order)
            logs = self.log_probability(grams.chars)
            length = np.bincount(grams.word, minlength=len(words))
            n = np.bincount(row, weights=length[which], minlength=n_rows)
            for k in range(n_langs):
                by_word = np.bincount(grams.word, weights=logs[:, k], minlength=len(words))
                sums[:, k] = np.bincount(row, weights=by_word[which], minlength=n_rows)
        return -sums / np.maximum(n, 1)[:, None], n

    def margins(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and the evidence for it: margin to the second in nats over the text, dampened by its root."""
        best = entropy.argmin(1)
        ordered = np.sort(entropy, 1)
        second = ordered[:, 1] if entropy.shape[1] > 1 else ordered[:, 0] + 1
        return best, (second - ordered[:, 0]) * np.sqrt(n)

    def calibrate(self, labelled: pd.DataFrame) -> None:
        """Fit score curve and rejection limits on texts with their labels."""
        if labelled.empty or not self.langs:
            return
        entropy, n = self.cross_entropy(pa.array(labelled["text"].tolist(), pa.string()))
        best, margin = self.margins(entropy, n)
        right = (np.array(self.langs, object)[best] == labelled["lang"].to_numpy()).astype(float)
        use = n > 0
        a, b = 0.0, 1.0
        for _ in range(50):  # Newton steps for a logistic curve, held near (0, 1) by a weak prior
            p = 1 / (1 + np.exp(-np.clip(a + b * margin[use], -30, 30)))
            g = np.array([(right[use] - p).sum() - a, ((right[use] - p) * margin[use]).sum() - (b - 1)])
            w = p * (1 - p)
            h = np.array([[w.sum() + 1, (w * margin[use]).sum()], [(w * margin[use]).sum(), (w * margin[use] ** 2).sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
        self.curve = (float(a), float(max(b, 0.0)))
        for k in range(len(self.langs)):
            own = use & (best == k) & (right == 1) & (n >= 20)
            if own.sum() >= 20:
                # a small sample cannot show its extreme quantile: three deviations at least
                self.limits[k] = max(np.quantile(entropy[own, k], LIMIT_QUANTILE), entropy[own, k].mean() + 3 * entropy[own, k].std())

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, rejected."""
        entropy, n = self.cross_entropy(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        best, margin = self.margins(entropy, n)
        lettered = n > 0
        score = np.where(lettered, 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -30, 30))), 0.0)
        own = entropy[np.arange(len(best)), best]
        names = [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
        return names, score, np.where(lettered, own, np.nan), ~lettered | (own > self.limits[best])


def write_models(counts: DataFrame, folder: str, order: int = ORDER) -> CharacterModels:
    """Models of the whole counts table (``lang``, ``gram``, ``n``), their arrays in files below ``folder``."""
    spark = counts.sparkSession
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # a lower order counts the distinct characters in front
        levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/level-{k}")
        levels[k] = spark.read.parquet(f"{folder}/level-{k}")
    tables = [levels[k].select(F.lit(k).alias("k"), "lang", "n") for k in levels]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    kinds = every.groupBy("k", "lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).toPandas()
    models = CharacterModels(order=order, langs=kinds["lang"].unique().tolist())
    if not models.langs:
        return models
    models.uniform = 1.0 / (levels[1].select("gram").distinct().count() + 1)
    files, path = store(folder)
    files.create_dir(f"{path}/models", recursive=True)
    for k in range(1, order + 1):
        mine = kinds[kinds["k"] == k].set_index("lang").loc[models.langs]
        size = int(mine["rows"].sum()) * (8 + 4 * len(models.langs))
        bits = max(0, int(np.ceil(np.log2(size / PART_BYTES)))) if k > 1 else 0  # order 1 has one context and as many rows as there are letters
        names = write_level(levels[k], models, k, bits, discounts(mine["once"].to_numpy(), mine["twice"].to_numpy()), f"{folder}/models")
        for tables, kind in ((models.grams, "grams"), (models.contexts, "contexts")):
            tables.append(HashTable([f"{names[i]}.{kind}" if i in names else None for i in range(2 ** bits)], len(models.langs), bits, f"{folder}/models"))
    return models


def write_level(level: DataFrame, models: CharacterModels, k: int, bits: int, discount: np.ndarray, folder: str) -> dict[int, str]:
    """Estimate order ``k`` from its counts and the files of the order below; names of the written files by part."""
    number = {x: i for i, x in enumerate(models.langs)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = characters(batch.column("gram").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(hashed(chars[:, :-1]), bits)), *batch.columns], ["part", "lang", "gram", "n"])

    def build(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        langs = np.array([number[x] for x in rows.column("lang").to_pylist()])
        keys, p, ctx_keys, backoff = estimate(characters(rows.column("gram").to_pylist(), k), langs, rows.column("n").to_numpy(), discount, models.lower(k))
        files, path = store(folder)
        name = f"{k}-{part}-{uuid.uuid4().hex}"  # an attempt that is repeated writes files of its own
        for kind, arrays in (("grams", (keys, p)), ("contexts", (ctx_keys, backoff))):
            with files.open_output_stream(f"{path}/{name}.{kind}") as f:
                for x in arrays:
                    f.write(x.tobytes())
        return pa.table({"part": [part], "name": [name]})

    dealt = level.select("lang", "gram", "n").mapInArrow(deal, "part bigint, lang string, gram string, n bigint")
    return {r["part"]: r["name"] for r in dealt.groupBy("part").applyInArrow(build, "part bigint, name string").collect()}


def train(labelled: DataFrame, calibration: DataFrame, order: int = ORDER) -> CharacterModels:
    """Models from all rows of ``labelled``; score and rejection from ``calibration``, ``CALIBRATION_DOCS`` rows at most."""
    spark = labelled.sparkSession
    folder = scratch_path(spark, "langid")
    count_grams(labelled, order).write.parquet(f"{folder}/counts")
    models = write_models(spark.read.parquet(f"{folder}/counts"), folder, order)
    models.calibrate(calibration.select("text", "lang").limit(CALIBRATION_DOCS).toPandas())
    return models


def set_aside(known: DataFrame) -> DataFrame:
    """``doc_id`` of the documents to calibrate with: those of the smallest hash of the id, one in ``ONE_ASIDE_IN`` and
    ``CALIBRATION_DOCS`` at most, none of a language with fewer than ``LEAST_ASIDE`` documents."""
    ids = known.select("doc_id", "lang").distinct()
    common = ids.groupBy("lang").count().where(F.col("count") >= LEAST_ASIDE).select("lang")
    able = ids.join(small(common), "lang", "left_semi").select("doc_id").distinct()
    return able.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(CALIBRATION_DOCS, able.count() // ONE_ASIDE_IN))


def predict(docs: DataFrame, models: CharacterModels) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``cross_entropy``, ``rejected`` for every row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # names of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            names, score, entropy, rejected = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Train on all labelled documents whose remainder (checksum of the id, mod 4) is not 2, but for those set aside to
    calibrate with; predict all.

    Adds ``held_out`` (remainder 2: neither text nor label of such a document is learned from).
    """
    learn = remainder(F.col("doc_id")) != 2  # null for a row without an id, which is left out
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    aside = durable(set_aside(known))
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang")).alias("one")  # of several texts of an id
    calibration = known.join(F.broadcast(aside), "doc_id", "left_semi").groupBy("doc_id").agg(one).select("one.*")
    models = train(known.join(F.broadcast(aside), "doc_id", "left_anti").select("lang", "text"), calibration)
    out = predict(docs, models)
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)))
