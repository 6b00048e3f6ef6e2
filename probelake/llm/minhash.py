"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

Each document gets ``BANDS`` x ``ROWS`` minima of its set of word shingles. Bands of minima make candidates; of
every minimum the low ``BITS`` bits are kept as bit planes, and the share of agreeing places, corrected for chance
agreement (one in 2^BITS), estimates the similarity with a few bit counts. Pairs that the estimate cannot rule out
(five standard deviations below the threshold) are confirmed on their full sets.

Documents with equal sets are folded into one representative first. No bucket of a band is compared pair by pair:

1. every member is compared with the bucket's smallest id only, confirmed pairs are linked, and components found;
2. members of such a bucket that are still in another component than its smallest id (usually few) are compared
   with the whole bucket, in bounded pieces: first by estimate alone, then, for members with an open pair, on full
   sets inside the task. Only links that join different components leave a task.

A pair with similarity exactly at the threshold misses all bands with probability (1 - 0.75^4)^32 = 5e-6.

Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds 64-bit hashes of five consecutive
words, or of the whole sequence if it is shorter.

Defined results: a null, empty or blank text has an empty set and is linked with nothing. Rows that share a
``doc_id`` are one document and are linked if any of their texts is. Rows without ``doc_id`` are linked with nothing
and kept. Other columns are ignored, whatever their names; an empty table gives an empty result; texts are hashed
whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.batches import by_bytes, hold_batches
from probelake.llm.graph import components
from probelake.session import scratch_path, small

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
THRESHOLD_PERCENT = 75
DEVIATIONS = 5
SALTS = 64
QUERY_PIECE, BUCKET_PIECE = 256, 512  # rows of a bucket that meet in a task
PORTION = 100_000  # shingles hashed at once
SPACE = r"[\x20\x09-\x0D]+"


def random_odd(n: int, seed: int = 1) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def agreements_needed() -> int:
    """Agreeing places of a pair at the threshold, less ``DEVIATIONS`` standard deviations."""
    k, chance = BANDS * ROWS, 0.5**BITS
    p = chance + (1 - chance) * THRESHOLD_PERCENT / 100
    return int(np.floor(k * p - DEVIATIONS * np.sqrt(k * p * (1 - p))))


def finish(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    import xxhash

    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SPACE)
    coded = pc.dictionary_encode(lists.flatten())
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    filled = np.array([w != "" for w in words], bool)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = filled[which] if len(which) else np.zeros(0, bool)
    w, row = hashes[which[real]], row[real]
    ends = np.searchsorted(row, np.arange(len(texts)), side="right")
    starts = np.searchsorted(row, np.arange(len(texts)), side="left")
    radix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            grams = grams * radix + w[j:len(w) - SHINGLE + 1 + j]
    grams = finish(grams)
    out = []
    for a, b in zip(starts, ends):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a:b - SHINGLE + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in w[a:b]:
                    h = h * radix + x
            out.append(finish(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """32-bit minima (rows: sets, none empty) under multiplicative permutations of the hashes."""
    out = np.empty((len(sets), len(factors)), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= PORTION):
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at:to - 1])])
        with np.errstate(over="ignore"):
            for k, f in enumerate(factors):
                out[at:to, k] = np.minimum.reduceat(flat * f, starts)
        at = to
    return out >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = least.reshape(len(least), BANDS, ROWS)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for j in range(ROWS):
            h = finish(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def bit_planes(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima: for every bit the places' bits packed into 64-bit words."""
    planes = [np.packbits(((least >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little") for j in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def listed(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).reshape(-1)), a.shape[1]).cast(pa.list_(pa.int64())) if len(a) else pa.array([], pa.list_(pa.int64()))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` (of the set), ``planes``, ``bands`` (null for an empty set)."""
    factors = random_odd(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = shingle_sets(batch.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            least = minima([sets[i] for i in full], factors)
            back = np.full(len(sets), -1, np.int64)
            back[full] = np.arange(len(full))
            take = pa.array(back, mask=back < 0)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()),
                 listed(bit_planes(least)).take(take), listed(band_keys(least)).take(take)],
                ["doc_id", "n_shingles", "digest", "planes", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest string, planes array<bigint>, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``id``, ``set``: the sorted shingle hashes of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = shingle_sets(batch.column("text"))
            offsets = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["id", "set"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "id bigint, set array<bigint>")


def agreements(p: Column, q: Column) -> Column:
    """Places at which two documents' kept bits agree."""
    words = BANDS * ROWS // 64
    differ = []
    for w in range(words):
        x = F.lit(0).cast("bigint")
        for j in range(BITS):
            x = x.bitwiseOR(F.get(p, F.lit(j * words + w)).bitwiseXOR(F.get(q, F.lit(j * words + w))))
        differ.append(F.bit_count(x))
    return F.lit(BANDS * ROWS) - sum(differ[1:], differ[0])


def similar(p: Column, q: Column) -> Column:
    common = F.size(F.array_intersect(p, q))
    return 100 * common >= THRESHOLD_PERCENT * (F.size(p) + F.size(q) - common)


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``names`` from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
        if held:
            last = np.array([held[-1].column(n)[held[-1].num_rows - 1].as_py() for n in names])
            if (keys[0] != last).any():
                yield pa.Table.from_batches(held)
                held = []
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    return pc.list_flatten(flat).to_numpy(zero_copy_only=False).reshape(-1, width)


def open_pairs(t: pa.Table, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of (query, other) rows in different components that the estimate leaves open and that meet in this
    band first."""
    planes, bands, comp = matrix(t.column("planes"), BANDS * ROWS * BITS // 64), matrix(t.column("bands"), BANDS), t.column("comp").to_numpy()
    query, key = t.column("query").to_numpy(zero_copy_only=False), t.column("key")[0].as_py()
    q, c = np.flatnonzero(query), np.flatnonzero(~query)
    words = BANDS * ROWS // 64
    apart = np.zeros((len(q), len(c)), np.int16)
    for w in range(words):
        x = np.zeros((len(q), len(c)), np.int64)
        for j in range(BITS):
            x |= planes[q, j * words + w][:, None] ^ planes[c, j * words + w][None, :]
        apart += np.bitwise_count(x.view(np.uint64)).astype(np.int16)
    i, j = np.nonzero((BANDS * ROWS - apart >= needed) & (comp[q][:, None] != comp[c][None, :]))
    i, j = q[i], c[j]
    place = np.argmax(bands == key, axis=1)  # the band of this bucket
    first = np.zeros(len(i), bool)
    for a in range(0, len(i), 65536):
        part = slice(a, a + 65536)
        first[part] = np.argmax(bands[i[part]] == bands[j[part]], axis=1) == place[i[part]]
    return i[first], j[first]


def confirmed(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sorted sets reach the threshold. The partners of a set are looked up in it, ``PORTION`` shingles (one set at least) at a time."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(i), bool)
    fit = np.flatnonzero(100 * np.minimum(sizes[i], sizes[j]) >= THRESHOLD_PERCENT * np.maximum(sizes[i], sizes[j])) if len(i) else i
    fit = fit[np.argsort(i[fit], kind="stable")]
    for mine in np.split(fit, np.flatnonzero(np.diff(i[fit])) + 1) if len(fit) else []:
        own, partner = sets[i[mine[0]]], j[mine]
        portion = np.cumsum(sizes[partner]) // PORTION
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(portion)) + 1):
            flat = np.concatenate([sets[k] for k in partner[part]])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum(sizes[partner[part]]) - sizes[partner[part]], dtype=np.int64)
            out[mine[part]] = 100 * common >= THRESHOLD_PERCENT * (len(own) + sizes[partner[part]] - common)
    return out


def pieces(rows: DataFrame) -> DataFrame:
    """Bucket rows (``key``, ``id``, ``open``, ``n_open``, ``n_all``) dealt into pieces in which open rows meet all others once."""
    many = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    side = rows.withColumn("_q", many("n_open", QUERY_PIECE)).withColumn("_c", many("n_all", BUCKET_PIECE))
    others = side.select("*", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("qp"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("_c")).cast("int").alias("cp"), F.lit(False).alias("query"))
    queries = side.where("open").select("*", F.pmod(F.xxhash64("id", F.lit(2)), F.col("_q")).cast("int").alias("qp"), F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("cp"), F.lit(True).alias("query"))
    return others.union(queries).drop("_q", "_c", "n_open", "n_all", "open")


def link_components(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``id``, ``component`` for the representatives that are linked with any other; ``marked``: written signatures of representatives."""
    spark = docs.sparkSession
    base = scratch_path(spark, "minhash")
    needed = agreements_needed()

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    # Round 1: every member of a bucket against its smallest id.
    members = marked.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    shared = kept(members.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    buckets = kept(members.join(shared, "key"), "buckets")
    planes = marked.select("doc_id", "planes")
    pairs = buckets.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    estimated = (
        pairs.join(planes.withColumnsRenamed({"doc_id": "a", "planes": "_p"}), "a").join(planes.withColumnsRenamed({"doc_id": "b", "planes": "_q"}), "b")
        .where(agreements(F.col("_p"), F.col("_q")) >= needed).select("a", "b")
    )
    stars = kept(estimated, "stars")
    asked = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    sets = kept(full_sets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(small(asked), "doc_id", "left_semi")), "star_sets")
    linked = stars.join(sets.withColumnsRenamed({"id": "a", "set": "_p"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "_q"}), "b")
    links = kept(linked.where(similar(F.col("_p"), F.col("_q"))).select("a", "b").distinct(), "links")
    labels = kept(components(links), "labels")

    # Round 2: members outside the component of their bucket's smallest id, against the whole bucket.
    own = small(labels.select("id", F.col("component").alias("_own")))
    leads = small(labels.select(F.col("id").alias("leader"), F.col("component").alias("_lead")))
    placed = buckets.join(own, "id", "left").join(leads, "leader", "left").withColumn("comp", F.coalesce("_own", "id"))
    opened = kept(placed.withColumn("open", F.col("comp") != F.coalesce("_lead", "leader")).select("key", "id", "comp", "open"), "placed")
    sizes = kept(opened.groupBy("key").agg(F.count_if("open").alias("n_open"), F.count(F.lit(1)).alias("n_all")).where("n_open > 0"), "open_buckets")
    rows = kept(opened.join(small(sizes), "key"), "open_rows")
    signed = marked.select(F.col("doc_id").alias("id"), "planes", "bands")
    order = ["key", "qp", "cp"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*order).sortWithinPartitions(*order)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, order):
            i, j = open_pairs(t, needed)
            hit = np.union1d(i, j)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([t.column("key")[0].as_py()] * len(hit), pa.int64()), pa.array(t.column("id").to_numpy()[hit])], ["key", "id"])

    open_ids = kept(dealt(pieces(rows.join(signed, "id"))).mapInArrow(estimate, "key bigint, id bigint").distinct(), "open_ids")
    asked = open_ids.select(F.col("id").alias("doc_id")).distinct()
    more_sets = kept(full_sets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(small(asked), "doc_id", "left_semi")), "open_sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, order):
            i, j = open_pairs(t, needed)
            column = t.column("set").combine_chunks()
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            good = confirmed(sets, i, j)
            if good.any():
                ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
                # one link for each pair of components is enough
                _, one = np.unique(np.stack([comp[i[good]], comp[j[good]]], 1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[good]][one]), pa.array(ids[j[good]][one])], ["a", "b"])

    confirmable = rows.join(open_ids, ["key", "id"]).join(signed, "id").join(more_sets, "id")
    more = kept(dealt(pieces(confirmable)).mapInArrow(confirm, "a bigint, b bigint").distinct(), "more_links")
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs`` (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    hold_batches(spark)
    base = scratch_path(spark, "near")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    signatures(docs).withColumn("salt", salt).write.parquet(f"{base}/signatures")
    signed = spark.read.parquet(f"{base}/signatures")
    # equal sets: the smallest id stands for all; copies are aggregated in slices
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    slices = real.groupBy("digest", "salt").agg(F.min("doc_id").alias("m"))
    least = slices.select("digest", "salt", F.min("m").over(Window.partitionBy("digest")).alias("rep"))
    real.select("doc_id", "digest", "salt").join(least, ["digest", "salt"]).select("doc_id", "rep", "digest").distinct().write.parquet(f"{base}/reps")
    reps = spark.read.parquet(f"{base}/reps")
    marked = real.join(reps.where("doc_id = rep").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "planes", "bands")
    marked.write.parquet(f"{base}/marked")
    found = link_components(docs, spark.read.parquet(f"{base}/marked"))
    if not reps.groupBy("doc_id").count().where("count > 1").isEmpty():
        # a repeated id stands under several sets: then equal sets are links between documents as well
        same = reps.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(same.union(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        by_doc = signed.select("doc_id", "n_shingles").join(found.withColumnsRenamed({"id": "doc_id"}), "doc_id", "left")
    else:
        # slices of a set carry its component to the documents, so copies of one set never meet in one task
        named = least.join(found, F.col("rep") == F.col("id"), "left").select("digest", "salt", F.coalesce("component", "rep").alias("component"))
        by_doc = signed.select("doc_id", "n_shingles", "digest", "salt").join(named, ["digest", "salt"], "left")
        by_doc = by_doc.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))
    component = F.coalesce("component", "doc_id")
    return by_doc.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay (one document of each group), with all their columns."""
    gone = near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
