"""Exact deduplication over content-defined chunk recipes (DataFrame functions only).

Every text is cut where its content says so (after a line or sentence end, between bounds), each chunk gets a
64-bit identifier, and a text becomes the ordered list of its chunk identifiers: its recipe. Chunk texts are
shuffled once, already deduplicated inside each map task, to verify that an identifier stands for one content
only; identifiers that fail are made longer by the rank of their content. From then on only recipes move.

Defined results: a null text counts as empty; an empty text has the empty recipe and equals other empty texts.
Rows that repeat a ``doc_id`` and its text are indistinguishable and share their fate; the row with the largest
``doc_id`` stays, rows without one lose against any other and all stay if none has one. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.session import scratch_path

MIN_CHUNK, MAX_CHUNK = 192, 2048  # characters
SALTS = 64  # copies of one text are aggregated in this many slices before they meet


def chunks(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a text, in order; joined they give the text again."""
    pattern = rf"(?s).{{{shortest},{longest}}}?(?:\n|[.!?] )|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column, id_bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if id_bits == 64 else F.pmod(h, F.lit(1 << id_bits))


def cut_once(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """Distinct chunks with their identifiers: ``h``, ``c``."""
    cut = docs.select(F.explode(chunks(F.col("text"))).alias("c"))
    return cut.select(chunk_id(F.col("c"), id_bits).alias("h"), "c").distinct()


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` without nulls) as ``doc_id``, ``recipe``, ``text_sha256``, written to the shared folder.

    The recipe is a list of verified identifiers: equal lists mean equal texts.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "recipes")
    ids = F.transform(chunks(F.col("text")), lambda c: chunk_id(c, id_bits))
    docs.select("doc_id", ids.alias("recipe"), F.sha2("text", 256).alias("text_sha256")).write.parquet(f"{base}/first")
    # the one time chunk texts move: does any identifier stand for several contents?
    cut_once(docs, id_bits).groupBy("h").count().where("count > 1").select("h").write.parquet(f"{base}/shared")
    first, shared = spark.read.parquet(f"{base}/first"), spark.read.parquet(f"{base}/shared")
    if shared.isEmpty():
        return first
    rank = F.row_number().over(Window.partitionBy("h").orderBy("c"))
    ambiguous = cut_once(docs, id_bits).join(shared, "h").withColumn("rank", rank)
    # Identifiers with several contents: (identifier, rank of the content) in place of the identifier, for all texts.
    occurrences = docs.select("doc_id", "text", F.posexplode(chunks(F.col("text"))).alias("pos", "c"))
    keyed = occurrences.withColumn("h", chunk_id(F.col("c"), id_bits)).withColumn("t", F.sha2("text", 256)).drop("text")
    ranked = keyed.dropDuplicates(["t", "pos"]).join(ambiguous, ["h", "c"], "left")
    longer = ranked.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("parts"))
    flat = longer.select(F.col("t").alias("text_sha256"), F.flatten(F.transform("parts", lambda p: F.array(p["h"], p["rank"].cast("bigint")))).alias("long"))
    fixed = first.join(flat, "text_sha256", "left").select("doc_id", F.coalesce("long", "recipe").alias("recipe"), "text_sha256")
    fixed.write.parquet(f"{base}/verified")
    return spark.read.parquet(f"{base}/verified")


def mark_copies(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row of ``docs``.

    A text held by many rows is aggregated in ``SALTS`` slices; the slices of one recipe meet in a window of at
    most ``SALTS`` rows, and rows join back to their own slice, so no task holds a whole group.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    known = recipes(texts, id_bits).withColumn("salt", salt)
    slices = known.groupBy("recipe", "salt").agg(F.max("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("recipe")
    groups = slices.select(
        "recipe", "salt", F.max("m").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size"))
    return known.join(groups, ["recipe", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = mark_copies(docs).where("kept").select("doc_id", F.col("text_sha256").alias("_sha")).distinct()
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["doc_id"]) & (digest == stays["_sha"]), "left_semi")
