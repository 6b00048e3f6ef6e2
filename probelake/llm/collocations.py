"""Phrase collocations per language from sorted streams of phrase counts.

Counting goes order by order. A phrase can only be frequent when both phrases one word shorter inside it are, so the
pass over order m counts only places whose two shorter phrases passed a bit filter of the frequent phrases of order
m - 1. The filter has no false negatives and a fixed largest size (``FILTER_BYTES``); beyond it, it lets more phrases
through to be counted, and results stay exact. A task counts distinct phrases of a slice of text as integer pairs
(phrase one shorter, word), Spark adds the counts of the phrases themselves.

The frequent phrases of all orders then form one stream that is kept in two orders. In prefix order (language, words
from the first on) the last row seen with k words is the first k words of the current row, so one ordered walk gives
the counts of all first parts; in suffix order (words from the last on) the same walk gives the counts of all rests.
Streams are cut into slices by range, and each slice is told the last rows before it. Both streams and the counts of
one-word extensions are then merge-joined by phrase.

Defined results: null texts count as empty, a null language is ``und``; repeated rows count each time; an empty table
gives an empty result; other columns are ignored, whatever their names. Texts are read whole. Score ties go to the
smallest cut; places go by score, count and phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelake.llm.batches import by_bytes
from probelake.session import scratch_path, small

UNKNOWN = "und"
BREAKS = r"[.,;:!?\x0A-\x0D]+"
FILTER_BYTES = 1 << 27  # the largest bit filter; 16 bits a phrase below that
SEGMENT = 1 << 15  # bits of one filter row
SLICE_ROWS = 100_000  # phrases of one slice of an ordered stream
TEXT_BYTES = 8_000_000  # of text counted at a time
RADIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a phrase from the hash of all words but the last and that of the last."""
    with np.errstate(over="ignore"):
        h = (h ^ word) * RADIX
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of texts without nulls: a sum of their bytes, each times a number that its place gives, mixed with the length."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(ends)
    spelled = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    place = (np.arange(len(spelled)) - np.repeat(ends[:-1] - ends[0], size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(place, RADIX) * (spelled + np.uint64(1)), dtype=np.uint64)])
        return mixed(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], size.astype(np.uint64))


class PhraseFilter:
    """Bits of the hashes of a set of phrases."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(n_bits - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(31)) & mask).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        a, b = self.places(h, len(self.bits) * 8)
        bit = lambda at: (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)


def filter_of(phrases: DataFrame, n: int) -> PhraseFilter:
    """The filter of ``n`` phrases (``lang``, ``phrase``): set bits are united by Spark, at most ``FILTER_BYTES`` reach the driver."""
    n_bits = min(8 * FILTER_BYTES, max(1 << 20, 1 << (16 * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase"), " ")
            coded = pc.dictionary_encode(words.flatten())
            word = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
            length = np.bincount(row, minlength=len(words))
            start = np.cumsum(length) - length
            h = word_hashes(batch.column("lang"))
            for k in range(int(length.max(initial=0))):
                longer = np.flatnonzero(length > k)
                h[longer] = mixed(h[longer], word[start[longer] + k])
            at = np.concatenate(PhraseFilter.places(h, n_bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array(at % SEGMENT)], ["segment", "bit"])

    bits = np.zeros(n_bits // 8, np.uint8)
    rows = phrases.select("lang", "phrase").mapInArrow(run, "segment bigint, bit bigint").groupBy("segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    for r in rows.toLocalIterator():
        at = r["segment"] * (SEGMENT // 8)
        bits[at:at + SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return PhraseFilter(bits)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; for every occurrence in order its word, its row and its piece."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS, " \n ")
    spaced = pc.replace_substring(spaced, "\t", " ")
    spaced = pc.replace_substring(spaced, " " * 8, " ")  # long runs of blanks become short; what is left of them splits into empty words
    lists = pc.split_pattern(spaced, " ")
    coded = pc.dictionary_encode(lists.flatten())
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    is_break = pc.equal(words, "\n").to_numpy(zero_copy_only=False)[which] if len(words) else np.zeros(0, bool)
    is_word = ~is_break & (pc.not_equal(words, "").to_numpy(zero_copy_only=False)[which] if len(words) else is_break)
    piece = np.cumsum(is_break) + row  # a break and a new row both start another piece
    return words, which[is_word], row[is_word], piece[is_word]


def count_phrases(docs: DataFrame, order: int, filters: list[PhraseFilter]) -> DataFrame:
    """``lang``, ``phrase``, ``n``: counts of the phrases of ``order`` words that the filters of all shorter orders let pass.

    Order 1 has all words, and a null phrase with the number of words of the language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, size=TEXT_BYTES):
            words, which, row, piece = tokens(batch.column("text"))
            if not len(which):
                continue
            langs = pc.dictionary_encode(pc.fill_null(batch.column("lang"), UNKNOWN))
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            spelled, lang_hash = word_hashes(words), word_hashes(langs.dictionary)
            # phrases of the current order: where they start, their number there, and per number language, words and hash
            at = np.arange(len(which))
            known, number = np.unique(lang * len(words) + which, return_inverse=True)
            of_lang, chain = known // len(words), [known % len(words)]
            h = mixed(lang_hash[of_lang], spelled[chain[0]])
            for m in range(1, order):
                good = shared.value[m - 1].holds(h)[number]
                at, number = at[good], number[good]
                joined = np.flatnonzero((at[1:] == at[:-1] + 1) & (piece[np.minimum(at[:-1] + m, len(which) - 1)] == piece[at[:-1]]) & (at[:-1] + m < len(which)))
                before, last = number[joined], which[at[joined] + m]
                known, number = np.unique(before * len(words) + last, return_inverse=True)
                head, tail = known // len(words), known % len(words)
                of_lang, chain, h = of_lang[head], [c[head] for c in chain] + [tail], mixed(h[head], spelled[tail])
                at = at[joined]
            n = np.bincount(number, minlength=len(known)).astype(np.int64)
            parts = [words.take(pa.array(c)) for c in chain]
            phrase = parts[0] if order == 1 else pc.binary_join_element_wise(*parts, " ")
            names = langs.dictionary.take(pa.array(of_lang))
            yield pa.RecordBatch.from_arrays([names, phrase, pa.array(n)], ["lang", "phrase", "n"])
            if order == 1:
                total = np.bincount(lang, minlength=len(langs.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs.dictionary, pa.nulls(len(total), pa.string()), pa.array(total)], ["lang", "phrase", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, base: str, max_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases with their counts of ``least`` or more (``lang``, ``phrase``, ``n``, ``m`` words), and the words of each language."""
    spark = docs.sparkSession
    filters: list[PhraseFilter] = []
    for m in range(1, max_words + 1):
        counted = count_phrases(docs, m, filters).where((F.col("n") >= least) | F.col("phrase").isNull())
        counted.withColumn("m", F.lit(m)).write.parquet(f"{base}/counts/{m}")
        found = spark.read.parquet(f"{base}/counts/{m}").where("phrase IS NOT NULL")
        n = found.count()
        if not n:
            break
        if m < max_words:
            filters.append(filter_of(found, n))
    every = spark.read.parquet(*[f"{base}/counts/{k}" for k in range(1, m + 1)])
    return every.where("phrase IS NOT NULL"), every.where("phrase IS NULL").select("lang", F.col("n").alias("total"))


def part_counts(phrases: DataFrame, base: str, max_words: int, reverse: bool) -> DataFrame:
    """``phrases`` plus ``part_1`` ... : the counts of their first (``reverse``: last) 1, 2, ... words, by one ordered walk.

    Every part of a frequent phrase is frequent, so it stands in the stream, before the phrase.
    """
    spark = phrases.sparkSession
    words = F.split("phrase", " ")
    keyed = phrases.withColumn("words", F.reverse(words) if reverse else words)
    n_slices = max(1, -(-phrases.count() // SLICE_ROWS))
    keyed.repartitionByRange(n_slices, "lang", "words").withColumn("slice", F.spark_partition_id()).write.parquet(base)
    kept = spark.read.parquet(base)
    of_order = [F.when(F.col("m") == k, F.col("n")) for k in range(1, max_words)]
    place = F.struct("lang", "words")
    ends = kept.groupBy("slice").agg(*[F.max_by("n", F.when(F.col("m") == k, place)).alias(f"end_{k}") for k in range(1, max_words)])
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    carried = ends.select("slice", *[F.last(f"end_{k}", ignorenulls=True).over(before).alias(f"end_{k}") for k in range(1, max_words)])
    walk = Window.partitionBy("slice").orderBy("lang", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = kept.select("*", *[F.last(x, ignorenulls=True).over(walk).alias(f"in_{k}") for k, x in enumerate(of_order, 1)])
    return walked.join(F.broadcast(carried), "slice", "left").select(
        "lang", "phrase", "words", "m", "n", *[F.coalesce(f"in_{k}", f"end_{k}").alias(f"part_{k}") for k in range(1, max_words)])


def extensions(stream: DataFrame, max_words: int, reverse: bool) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of every extension by one word: the phrase is the longer one without its last word in the stream's order."""
    shorter = F.slice("words", F.lit(1), F.col("m") - 1)
    phrase = F.array_join(F.reverse(shorter) if reverse else shorter, " ")
    return stream.where("m > 1").select("lang", phrase.alias("phrase"), "n")


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(22,0)") * n.cast("decimal(15,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def mine(docs: DataFrame, max_words: int = 5, least: int = 100, top: int = 2000, cover_percent: int = 100) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of every language by their weakest cut.

    Phrases occur at least ``least`` times. A phrase that lies inside a longer one with ``cover_percent`` or more of
    its count is dropped; the longest extensions need no look of their own, as a one-word extension inside them
    occurs at least as often. Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, and
    ``cut`` (words of the first part). ``docs`` has ``lang`` and ``text``.
    """
    spark: SparkSession = docs.sparkSession
    base = scratch_path(spark, "phrases")
    phrases, totals = frequent_phrases(docs.select("lang", "text"), base, max_words, least)
    left = part_counts(phrases, f"{base}/prefix", max_words, False)
    right = part_counts(phrases, f"{base}/suffix", max_words, True)
    longer = extensions(left, max_words, False).unionByName(extensions(right, max_words, True)).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    firsts = left.where("m > 1").select("lang", "phrase", "m", F.col("n").alias("a"), *[F.col(f"part_{k}").alias(f"l_{k}") for k in range(1, max_words)])
    rests = right.where("m > 1").select("lang", "phrase", *[F.col(f"part_{k}").alias(f"r_{k}") for k in range(1, max_words)])
    met = firsts.hint("merge").join(rests, ["lang", "phrase"]).hint("merge").join(longer, ["lang", "phrase"], "left") \
        .where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True))).join(small(totals), "lang")
    rest_of = lambda k: F.get(F.array(*[F.col(f"r_{j}") for j in range(1, max_words)]), F.col("m") - k - 1)
    cuts = [F.when(F.col("m") > k, F.struct(
        cut_score(F.col("a"), F.col("total"), F.col(f"l_{k}"), rest_of(k)).alias("score"), F.lit(k).alias("cut"), F.col(f"l_{k}").alias("l"), rest_of(k).alias("r")))
        for k in range(1, max_words)]
    scored = met.withColumn("best", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", "phrase", "a", F.col("total").alias("n"), "best.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("bigint").alias("cut"))
