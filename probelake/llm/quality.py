"""Line-first quality rules (DataFrame functions only, no shuffle).

Each line is judged on its own: it must end like a sentence, not be a menu or a table row, not be boilerplate,
and not drown in symbols. Failing lines are removed. A document is rejected when the base rule fails (under
``MIN_WORDS`` words, or over a fifth of its words inside repeated five-word windows) or when the removed lines
held more than ``MAX_LOST_PERCENT`` percent of its characters.

Defined results: a null or empty text has no words, so it fails the base rule; its cleaned text is empty. Lines
without a word are neither judged nor counted. Other columns pass through whatever their names; an empty table
gives an empty result. A text of any length is one row and is judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, WINDOW = 10, 5
MAX_LOST_PERCENT = 50

# Line rules. All are regular expressions that Java and RE2 read alike.
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*\z"
MENU_MARK = r"[|»›·•]|->"
MENU_WORDS_PER_MARK = 4  # a line with two marks or more and at most this many words for each is navigation
SYMBOL = r"[#*$%&|<>]"
SHOUT = r"!!|\?\?"
NOISE_WORDS_PER_MARK = 4  # a line with a symbol or shout for every so many words is noise
BOILERPLATE = (r"(?i)\b(licensed under|released under the|all rights reserved|general public license|privacy policy"
               r"|terms of (use|service)|cookie|enable javascript|lorem ipsum|subscribe to our|sign (in|up) to"
               r"|click here|copyright \(c\)|©)")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"{SPACE}+", -1), "")


def repeated_windows(pairs: Column) -> Column:
    """Ascending positions of the windows that occur twice or more, from sorted (hash, position) pairs."""
    return F.array_sort(F.transform(
        F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])),
        lambda x: x["i"]))


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_t`` (text), ``_lines``, and the base columns; windows are compared by 64-bit hashes of their words."""
    step = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", " " * 5)) != "")
    step = step.withColumn("_lines", lines).withColumn("n_words", F.size("_w").cast("bigint"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    step = step.withColumn("_h", F.when(F.col("n_words") >= WINDOW, hashes).otherwise(none))
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    step = step.withColumn("_at", repeated_windows(F.col("_s")))
    gaps = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))))
    return step.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOL)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("bigint"),
    }).drop("_w", "_h", "_s", "_at")


def line_passes(line: Column) -> Column:
    trimmed = F.trim(line, F.lit(SPACES))  # from both ends: no pattern that starts anew at every blank of a long run
    n_words = F.size(F.split(trimmed, rf"{SPACE}+", -1))
    marks = F.regexp_count(line, F.lit(MENU_MARK))
    noise = F.regexp_count(line, F.lit(f"{SYMBOL}|{SHOUT}"))
    menu = (marks >= 2) & (n_words <= marks * MENU_WORDS_PER_MARK)
    return (F.regexp_like(trimmed, F.lit(SENTENCE_END)) & ~menu & ~(noise * NOISE_WORDS_PER_MARK >= n_words)
            & ~F.regexp_like(line, F.lit(BOILERPLATE)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``n_lines``, ``n_lines_removed``, ``chars_removed``, ``clean_text``, ``kept``."""
    return judged(docs.select("doc_id", "text")).drop("text")


def judged(docs: DataFrame) -> DataFrame:
    """``docs``, of which this module owns all names but ``text``, plus the columns of ``judge``."""
    base = text_counts(docs).withColumn("_good", F.filter("_lines", line_passes))
    chars = lambda c: F.length(F.array_join(c, ""))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = base.withColumns({
        "base_failed": failed,
        "n_lines": F.size("_lines").cast("bigint"),
        "n_lines_removed": (F.size("_lines") - F.size("_good")).cast("bigint"),
        "_all": chars("_lines").cast("bigint"),
        "chars_removed": (chars("_lines") - chars("_good")).cast("bigint"),
        "clean_text": F.array_join("_good", "\n"),
    })
    # The partition number keeps filters on the result from moving below this point, where the optimizer would put
    # whole expressions in place of columns and evaluate them once per array element.
    kept = ~F.col("base_failed") & (100 * F.col("chars_removed") <= MAX_LOST_PERCENT * F.col("_all")) & (F.spark_partition_id() >= 0)
    return out.withColumn("kept", kept).drop("_t", "_lines", "_good", "_all")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, their text without the failing lines; same columns (``n_chars``, if there, follows)."""
    names = docs.columns
    stay = judged(docs.select(F.struct("*").alias("_row"), "text")).where("kept")
    new = {"text": F.col("clean_text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return stay.select(*[new.get(n, F.col("_row")[n]).alias(n) for n in names])
