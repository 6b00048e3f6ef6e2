"""Spelling variants: all pairs of vocabulary words one edit apart, by composing acceptors with a one-edit transducer.

The pairs are what the composition of the vocabulary acceptor, a transducer of exactly one edit and the acceptor again
accepts. It is enumerated one initial state at a time: a pair whose edit falls into the characters [lo, hi) of the
shorter word shares the characters before and after, so the words of one length class that share them form one
partition, and only their middles need an acceptor. A partition builds the minimal acceptor of its middles with the
number of words behind every state, so that a path spells a word's rank. Before the edit both words walk through the
same states; at a state the edit exchanges two outgoing labels or inserts one, and what follows must be accepted from
both states reached: the product of two states is listed once, whatever leads there, and then placed behind every
path to the state. A pair is reported for the first place where its words differ, so by one partition only.

Words first meet in halves. A partition of more than ``GROUP_WORDS`` words or ``GROUP_CHARS`` characters of middles
is dealt again by half of its middle, down to one character, where only a few thousand words can share all the others. No
partition is capped and no pair is emitted that is not accepted; a task sums the pairs up by word.

Defined results: null texts count as empty, a null ``doc_id`` as empty text in the checksum; repeated rows count each
time; an empty table gives an empty result; other columns are ignored, whatever their names. Words of any length are
compared whole; ties of a form go to the first word in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.session import scratch_path, small

RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP_WORDS, GROUP_CHARS = 20_000, 400_000
OUT_ROWS = 50_000


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct strings; children have smaller numbers than their parents."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.labels: list[tuple[str, ...]] = []
        self.targets: list[tuple[int, ...]] = []
        self.offsets: list[tuple[int, ...]] = []  # words of the state before those of each label
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        open_states: list[list] = [[False, [], []]]  # the path of the last word: final, labels, targets
        last = ""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, labels, targets = open_states.pop()
                key = (final, tuple(labels), tuple(targets))
                number = known.get(key)
                if number is None:
                    number = known[key] = self.add(*key)
                open_states[-1][2].append(number)

        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            close(shared)
            for c in word[shared:]:
                open_states[-1][1].append(c)
                open_states.append([False, [], []])
            open_states[-1][0] = True
            last = word
        close(0)
        final, labels, targets = open_states[0]
        self.start = self.add(final, tuple(labels), tuple(targets))

    def add(self, final: bool, labels: tuple, targets: tuple) -> int:
        offsets, total = [], int(final)
        for t in targets:
            offsets.append(total)
            total += self.size[t]
        self.final.append(final)
        self.labels.append(labels)
        self.targets.append(targets)
        self.offsets.append(tuple(offsets))
        self.size.append(total)
        return len(self.size) - 1

    def paths(self) -> list[np.ndarray]:
        """For every state the ranks at which the words through it start, one for each path to it."""
        parts: list[list[np.ndarray]] = [[] for _ in self.size]
        parts[self.start] = [np.zeros(1, np.int64)]
        out = [np.zeros(0, np.int64)] * len(self.size)
        for q in range(len(self.size) - 1, -1, -1):
            out[q] = np.concatenate(parts[q]) if parts[q] else out[q]
            parts[q] = []
            for t, offset in zip(self.targets[q], self.offsets[q]):
                parts[t].append(out[q] + offset)
        return out


class OneEdit:
    """Pairs of an acceptor's words that differ by exactly one replaced or inserted character."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.met: dict[tuple[int, int], np.ndarray] = {}

    def common(self, p: int, q: int) -> np.ndarray:
        """Ranks (behind ``p``, behind ``q``) of the strings accepted from both states."""
        a, met = self.a, self.met
        todo = [(p, q)]
        while todo:
            x, y = todo[-1]
            if (x, y) in met:
                todo.pop()
            elif x == y:
                met[x, y] = np.repeat(np.arange(a.size[x]), 2).reshape(-1, 2)
            else:
                at = dict(zip(a.labels[y], range(len(a.labels[y]))))
                shared = [(i, at[c]) for i, c in enumerate(a.labels[x]) if c in at]
                missing = [pair for i, j in shared if (pair := (a.targets[x][i], a.targets[y][j])) not in met]
                if missing:
                    todo += missing
                    continue
                parts = [np.zeros((int(a.final[x] and a.final[y]), 2), np.int64)]
                parts += [met[a.targets[x][i], a.targets[y][j]] + (a.offsets[x][i], a.offsets[y][j]) for i, j in shared]
                met[x, y] = np.concatenate(parts)
        return met[p, q]

    def at_state(self, q: int, to_end: bool) -> np.ndarray:
        """Pairs of ranks behind ``q`` whose strings differ in the first character. ``to_end``: also the empty string and one character."""
        a = self.a
        labels, targets, offsets = a.labels[q], a.targets[q], a.offsets[q]
        found = []
        for i, (t, at) in enumerate(zip(targets, offsets)):
            for u, before in zip(targets[i + 1:], offsets[i + 1:]):
                found.append(self.common(t, u) + (at, before))  # one character replaced
            inner = dict(zip(a.labels[t], range(len(a.labels[t]))))
            if to_end and a.final[q] and a.final[t]:
                found.append(np.array([[0, at]]))
            for label, u, before in zip(labels, targets, offsets):  # the longer word has one character more here
                j = inner.get(label)
                if j is not None and label != labels[i]:
                    found.append(self.common(u, a.targets[t][j]) + (before, at + a.offsets[t][j]))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def pairs(self, to_end: bool) -> np.ndarray:
        paths = self.a.paths()
        out = [np.zeros((0, 2), np.int64)]
        for q, starts in enumerate(paths):
            behind = self.at_state(q, to_end) if len(self.a.labels[q]) else out[0]
            if len(behind):
                out.append((behind[None] + starts[:, None, None]).reshape(-1, 2))
        return np.concatenate(out)


def partition_pairs(words: list[str], lo: int, hi: int, chars: int) -> np.ndarray:
    """Pairs of numbers of ``words``: one edit apart, first different at [lo, hi) (or at the end), the shorter one of ``chars`` characters.

    All words share their first ``lo`` characters and those from ``hi`` of the shorter length on.
    """
    behind = chars - hi
    middles = [w[lo:len(w) - behind] for w in words]
    order = sorted(range(len(words)), key=middles.__getitem__)
    found = OneEdit(Acceptor([middles[i] for i in order])).pairs(to_end=hi == chars)
    found = np.array(order, np.int64)[found]
    length = np.array([len(w) for w in words])
    return found[np.minimum(length[found[:, 0]], length[found[:, 1]]) == chars]


def summed(words: list[str], n: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a partner: their numbers, how many partners, and the partner of the largest ``n`` (ties: first in code-point order)."""
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    source, target = np.concatenate([pairs, pairs[:, ::-1]]).T
    by = np.lexsort((place[target], -n[target], source))
    source, first, count = np.unique(source[by], return_index=True, return_counts=True)
    return source, count, target[by][first]


def segment_rows(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``key``: what words of a partition share (class, place and text around [lo, hi))."""
    tail = F.col("chars") - F.col("hi")
    around = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("|"), F.when(tail > 0, F.substring("word", F.char_length("word") - tail + 1, tail)).otherwise(""))
    short = F.when(F.col("chars") <= 40, around).otherwise(F.sha2(around, 256))
    return rows.withColumn("key", F.concat_ws("|", "chars", "lo", "hi", short))


def near_in_partitions(rows: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``near_n``, ``near_word`` for each word and partition with a partner in it; partitions are whole."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, words, n, shape = None, [], [], None
        for batch in batches:
            keys, w, c = (batch.column(x).to_pylist() for x in ("key", "word", "n"))
            shapes = list(zip(*(batch.column(x).to_pylist() for x in ("lo", "hi", "chars"))))
            for i, k in enumerate(keys):
                if k != key:
                    if len(words) > 1:
                        yield words, n, shape
                    key, words, n, shape = k, [], [], shapes[i]
                words.append(w[i])
                n.append(c[i])
        if len(words) > 1:
            yield words, n, shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "near_n", "near_word"])
            for x in out:
                x.clear()
            return made

        for words, n, shape in groups(batches):
            pairs = partition_pairs(words, *shape)
            if not len(pairs):
                continue
            n = np.array(n, np.int64)
            source, count, best = summed(words, n, pairs)
            out[0] += [words[i] for i in source]
            out[1] += count.tolist()
            out[2] += n[best].tolist()
            out[3] += [words[i] for i in best]
            if len(out[0]) >= OUT_ROWS:
                yield batch()
        yield batch()

    dealt = rows.select("key", "word", "n", "lo", "hi", "chars").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, n_near bigint, near_n bigint, near_word string")


def near_words(words: DataFrame, base: str, min_chars: int, group_words: int = GROUP_WORDS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word``, ``n_near``, ``near_n``, ``near_word`` (partial, to be summed up by word) of ``words`` (``word``, ``n``; distinct)."""
    spark = words.sparkSession
    length = F.char_length("word")
    halves = [F.when(F.lit(lo_hi[0]) < lo_hi[1], F.struct(*(F.lit(x).cast("int").alias(name) if isinstance(x, int) else x.cast("int").alias(name)
                                                             for x, name in zip((*lo_hi, chars), ("lo", "hi", "chars")))))
              for chars in (length, length - 1) for lo_hi in ((0, F.floor(chars / 2)), (F.floor(chars / 2), chars))]
    rows = words.select("word", "n", F.explode(F.array_compact(F.array(*halves))).alias("s")).select("word", "n", "s.*").where((F.col("chars") >= min_chars) & (F.col("lo") < F.col("hi")))
    rows = segment_rows(rows)
    out, level = None, 0
    while True:
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("hi") - F.col("lo")).alias("size")).where((F.col("rows") > 1) & ((F.col("rows") > group_words) | (F.col("size") > group_chars))) \
            .select("key").write.parquet(f"{base}/hot/{level}")
        hot = spark.read.parquet(f"{base}/hot/{level}")
        any_hot = not hot.isEmpty()
        splits = F.col("hi") - F.col("lo") > 1
        cold = rows.where(splits).join(small(hot), "key", "left_anti").unionByName(rows.where(~splits)) if any_hot else rows
        found = near_in_partitions(cold)
        out = found if out is None else out.unionByName(found)
        if not any_hot:
            return out
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        again = rows.where(splits).join(small(hot), "key", "left_semi") \
            .select("word", "n", "chars", F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("s")).select("word", "n", "chars", "s.*")
        level += 1
        segment_rows(again).write.parquet(f"{base}/again/{level}")
        rows = spark.read.parquet(f"{base}/again/{level}")
        if rows.isEmpty():
            return out


def roots(forms: DataFrame, base: str) -> DataFrame:
    """``word``, ``root`` for the words with a form (``word``, ``form``), by doubling; counts grow tenfold a step, so chains are short."""
    spark = forms.sparkSession
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{base}/roots/0")
    step = 0
    while True:
        now = spark.read.parquet(f"{base}/roots/{step}")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).write.parquet(f"{base}/roots/{step}")
        done = spark.read.parquet(f"{base}/roots/{step}")
        if done.where("moved").isEmpty():
            return done.select("word", "root")


def slipped(doc_id: Column, run: Column, one_in: int) -> Column:
    """The lower-cased run, without one character where ``one_in`` divides the checksum of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_chars: int = 7, min_n: int = 2, one_in: int = 31) -> DataFrame:
    """``word``, ``n``: letter runs of all texts with the planted slips, of at least ``min_chars`` characters and ``min_n`` occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{RUN}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = lowered.select(slipped(F.col("doc_id"), F.col("run"), one_in).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)


def group_variants(docs: DataFrame, min_chars: int = 7, min_n: int = 2, ratio: int = 10, one_in: int = 31,
                   group_words: int = GROUP_WORDS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word of ``docs`` (``doc_id``, ``text``).

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them if it is ``ratio`` times as
    frequent as the word; ``root`` is reached by following forms.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "spelling")
    vocabulary(docs.select("doc_id", "text"), min_chars, min_n, one_in).write.parquet(f"{base}/words")
    words = spark.read.parquet(f"{base}/words")
    near = near_words(words, base, min_chars, group_words, group_chars).withColumn("n", F.lit(None).cast("bigint"))
    own = words.select("word", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("near_n"), F.lit(None).cast("string").alias("near_word"), "n")
    best = F.min(F.when(F.col("near_n").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near_word").alias("w")))).alias("best")
    by_word = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    fits = -F.col("best.m") >= ratio * F.col("n")
    by_word.select("word", "n", "n_near", F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")).write.parquet(f"{base}/forms")
    formed = spark.read.parquet(f"{base}/forms")
    return formed.join(roots(formed.where("form IS NOT NULL"), base), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
