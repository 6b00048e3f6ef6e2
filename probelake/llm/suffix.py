"""Removal of byte strings that repeat across documents, by suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller ``doc_id``.
Suffixes of a whole corpus cannot be sorted in one place, so content decides which suffixes meet:

1. Every string of ``LENGTH`` bytes elects an anchor, the smallest hash among its ``GRAM``-byte substrings. Equal
   strings elect equal anchors at equal places. Anchors meet by hash, packed into one row per batch and part, and
   only those that several documents hold go on. A batch sends a hash of several of its own documents once.
2. Around each such anchor the strings that elect it are cut out of the text as one context. Contexts meet by the
   anchor's bytes. A batch sends equal contexts once, for its smallest document; its others are settled in place.
3. A task sorts the suffixes of its distinct contexts in two stages: suffixes smaller than their successors are sorted
   directly, to ``SORTED`` bytes, the others follow from them by scans over the buckets of first bytes. Adjacent
   common prefixes of ``LENGTH`` bytes give runs of equal strings, and the smallest document of each run.
4. The covered ranges of a document are merged and cut out of its text.

Copies of a whole text are settled by their checksum and never reach step 2. Text moves only for documents with an
anchor of step 1 or a range of step 4; if their ids fit a checked bound they are broadcast, else joined.

Defined results: a null text is empty; shorter texts than ``LENGTH`` lose nothing. Rows with the same ``doc_id``
are neither earlier nor later than each other; rows without one are compared with nothing. Other columns are
ignored, whatever their names; an empty table gives an empty result; texts are judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.batches import by_bytes
from probelake.session import scratch_path, small

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM + 1  # places at which a string's anchor can start
SORTED = 50
SALTS = 64
PARTS_PER_PARTITION = 4
PORTION = 2_000_000  # bytes hashed at once
SENT_TOGETHER = 8_000_000  # bytes whose anchors or contexts are made distinct before they are sent
RADIX = 0x9E3779B97F4A7C15
BYTE_HASH = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every place, by doubling (16 + 4); odd, so never 0."""
    with np.errstate(over="ignore"):
        power = lambda n: np.uint64(pow(RADIX, n, 1 << 64))
        h = BYTE_HASH[t]
        four = None
        for n in (1, 2, 4, 8):
            h = h[:-n] * power(n) + h[n:]
            if n == 2:
                four = h
        h = h[:len(four) - 16] * power(4) + four[16:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h | np.uint64(1)


def full_strings(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places at which ``LENGTH`` bytes of one text start."""
    step = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - LENGTH + 1, -1)
    return np.cumsum(step[:n]) > 0


def anchors(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in the texts ``t[starts:ends]``, and their hashes."""
    if len(t) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(t)
    m = h
    for n in (1, 2, 4, 8):
        m = np.minimum(m[:-n], m[n:])
    m = np.minimum(m[:len(m) - REACH + 16], m[REACH - 16:])  # over REACH places
    m = np.where(full_strings(len(t), starts, ends)[:len(m)], m, np.uint64(0))
    x = np.concatenate([np.zeros(REACH - 1, np.uint64), m, np.zeros(REACH - 1, np.uint64)])
    for n in (1, 2, 4, 8):
        x = np.maximum(x[:-n], x[n:])
    x = np.maximum(x[:len(x) - REACH + 16], x[REACH - 16:])
    place = np.flatnonzero(x[:len(h)] == h)
    return place, h[place]


def elected(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all full strings, and of the anchor each elects (the leftmost smallest)."""
    if len(t) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = gram_hashes(t)
    at = np.arange(len(m), dtype=np.int32)

    def merge(m: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        left = m[:len(m) - n] <= m[n:]
        return np.where(left, m[:len(m) - n], m[n:]), np.where(left, at[:len(at) - n], at[n:])

    for n in (1, 2, 4, 8):
        m, at = merge(m, at, n)
    m, at = merge(m, at, REACH - 16)
    place = np.flatnonzero(full_strings(len(t), starts, ends)[:len(m)])
    return place, at[place].astype(np.int64)


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is not (the end is smaller than all)."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    up = t[differs + 1] > t[differs]
    nxt = np.searchsorted(differs, np.arange(n))  # the next change at or after each place
    out = np.zeros(n, bool)
    known = nxt < len(differs)
    out[known] = up[nxt[known]]
    return out


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffixes of ``t`` (bytes), sorted by their first ``SORTED`` bytes at least, in two stages."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    small_ = smaller_than_next(t)
    direct = np.flatnonzero(small_)
    padded = np.concatenate([t, np.zeros(SORTED, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, SORTED)[direct].reshape(-1).view(f"S{SORTED}") if len(direct) else np.zeros(0, f"S{SORTED}")
    direct = direct[np.argsort(keys, kind="stable")]
    edges = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []

    def hand_on(found: np.ndarray, c: int) -> np.ndarray:
        """Predecessors that are larger than their successors: those of higher buckets wait there, own ones are returned."""
        before = found[found > 0] - 1
        before = before[~small_[before]]
        first = t[before]
        higher = before[first > c]
        if len(higher):
            kind = t[higher]
            rank = np.argsort(kind, kind="stable")
            higher, kind = higher[rank], kind[rank]
            cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            for part in np.split(higher, cuts):
                waiting[t[part[0]]].append(part)
        return before[first == c]

    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(front):
            out.append(front)
            front = hand_on(front, c)
        own = direct[edges[c]:edges[c + 1]]
        if len(own):
            out.append(own)
            hand_on(own, c)
    return np.concatenate(out)


def adjacent_equal(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``order`` has its first ``LENGTH`` bytes in common with the one before it."""
    padded = np.concatenate([t, np.zeros(LENGTH + 8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8).reshape(-1, 8).copy().view(np.uint64).reshape(-1)
    equal = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = np.ones(len(a), bool)
        for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
            same &= word[a + k] == word[b + k]
        equal[1:] = same
    return equal


def repeated_strings(t: np.ndarray, valid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the ``valid`` places (``doc``: their documents) start a string that a smaller document has, too."""
    order = suffix_order(t)
    rank_of = np.full(len(t), -1, np.int64)
    rank_of[valid] = np.arange(len(valid))
    kept = order[rank_of[order] >= 0]
    fresh = ~adjacent_equal(t, kept)
    run = np.cumsum(fresh) - 1
    own = doc[rank_of[kept]]
    least = np.minimum.reduceat(own, np.flatnonzero(fresh)) if len(kept) else own
    out = np.zeros(len(valid), bool)
    out[rank_of[kept]] = least[run] < own
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column, and where each text starts and ends."""
    blobs = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset:blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2], np.uint8) if blobs.buffers()[2] is not None and blobs.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def portions(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Runs of texts of about ``PORTION`` bytes."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PORTION, side="right")))
        yield slice(a, b)
        a = b


FLAGGED = "part int, kind boolean, h binary, doc binary, v binary, pos binary"


def send_anchors(n_parts: int):
    """Anchors of each batch packed by part; kind: their documents are already known to share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, size=SENT_TOGETHER):
            t, starts, ends = text_bytes(batch.column("text"))
            ids, vs = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)
            rows, places, hashes = [], [], []
            for part in portions(starts, ends):
                base, end = starts[part][0], ends[part][-1]
                place, h = anchors(t[base:end], starts[part] - base, ends[part] - base)
                row = np.searchsorted(ends[part] - base, place, side="right")
                rows.append(row + part.start)
                places.append(place - (starts[part] - base)[row])
                hashes.append(h)
            if not rows:
                continue
            row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
            order = np.lexsort((ids[row], h))
            row, place, h = row[order], place[order], h[order]
            if not len(h):
                continue
            doc = ids[row]
            fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.concatenate([fresh[1:], [len(h)]]) - 1
            several = np.repeat(doc[fresh] != doc[last], np.diff(np.concatenate([fresh, [len(h)]])))
            first = np.zeros(len(h), bool)
            first[fresh] = True
            out = []
            for known, use in ((False, ~several), (True, several & first), (None, several)):
                k = np.flatnonzero(use)
                # a hash of several documents is sent once as known; all its places go along as settled
                part = (h[k] >> np.uint64(7)) % np.uint64(n_parts)
                rank = np.argsort(part, kind="stable")
                k, part = k[rank], part[rank]
                cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(k)]):
                    if b > a:
                        s = k[a:b]
                        out.append((int(part[a]), known, h[s].tobytes(), doc[s].tobytes(), vs[row[s]].tobytes(), place[s].astype(np.int64).tobytes()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
                ["part", "kind", "h", "doc", "v", "pos"])

    return run


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one part after the other (batches sorted by part)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def placed(doc: np.ndarray, v: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places of each document as one row."""
    order = np.lexsort((pos, v, doc))
    doc, v, pos = doc[order], v[order], pos[order]
    if not len(doc):
        return
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(doc)), pa.int32()), pa.array(pos))
    yield pa.RecordBatch.from_arrays([pa.array(doc[fresh]), pa.array(v[fresh]), lists], ["doc_id", "v", "pos"])


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose anchor several documents hold."""
    for rows in by_part(batches):
        column = lambda name, kind, some: np.concatenate([np.frombuffer(r[name], kind) for r in some]) if some else np.zeros(0, kind)
        settled = [r for r in rows if r["kind"] is None]
        asked = [r for r in rows if r["kind"] is not None]
        h, doc = column("h", np.uint64, asked), column("doc", np.int64, asked)
        v, pos = column("v", np.int64, asked), column("pos", np.int64, asked)
        known = np.concatenate([np.full(len(r["h"]) // 8, r["kind"]) for r in asked]) if asked else np.zeros(0, bool)
        order = np.argsort(h, kind="stable")
        h, doc, v, pos, known = h[order], doc[order], v[order], pos[order], known[order]
        hit = np.zeros(0, bool)
        if len(h):
            fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(fresh, len(h)))
            several = (np.minimum.reduceat(doc, fresh) < np.maximum.reduceat(doc, fresh)) | np.logical_or.reduceat(known, fresh)
            hit = np.repeat(several, size) & ~known
        yield from placed(np.concatenate([doc[hit], column("doc", np.int64, settled)]), np.concatenate([v[hit], column("v", np.int64, settled)]),
                          np.concatenate([pos[hit], column("pos", np.int64, settled)]))


def send_contexts(n_parts: int):
    """Contexts of the flagged anchors packed by part of the anchor's bytes; ranges settled inside the batch have no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, size=SENT_TOGETHER):
            t, starts, ends = text_bytes(batch.column("text"))
            ids, vs = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)
            flags = batch.column("pos")
            row, pos = pc.list_parent_indices(flags).to_numpy(zero_copy_only=False), pc.list_flatten(flags).to_numpy(zero_copy_only=False)
            flagged = np.zeros(len(t) + 1, bool)
            flagged[starts[row] + pos] = True
            cut: dict[bytes, list[tuple[int, int, int, int, int]]] = {}
            for part in portions(starts, ends):
                base, end = starts[part][0], ends[part][-1]
                place, anchor = elected(t[base:end], starts[part] - base, ends[part] - base)
                use = flagged[anchor + base]
                place, anchor = place[use] + base, anchor[use] + base
                if not len(place):
                    continue
                # neighbouring strings with one anchor are one context; equal strings elect at equal distance
                fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)]))
                last = np.append(fresh[1:], len(place)) - 1
                rows = np.searchsorted(ends, place[fresh], side="right")
                data = t[base:end].tobytes()
                for a, b, p, r in zip(place[fresh].tolist(), place[last].tolist(), anchor[fresh].tolist(), rows.tolist()):
                    cut.setdefault(data[a - base:b - base + LENGTH], []).append((int(ids[r]), int(vs[r]), a - int(starts[r]), b - a + LENGTH, p - a))
            parts: dict[int, list[tuple]] = {}
            settled: list[tuple[int, int, int, int]] = []
            for context, found in cut.items():
                found.sort()
                doc, v, at, size, lead = found[0]
                settled += [(d, w, a, a + s) for d, w, a, s, _ in found if d != doc]
                for d, w, a, s, p in found:
                    if d == doc:
                        key = context[p:p + GRAM]
                        parts.setdefault(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little") % n_parts, []).append((context, d, w, a))
            out = []
            for part, some in parts.items():
                contexts, docs, variants, at = zip(*some)
                out.append((part, b"".join(contexts), np.array([len(c) for c in contexts], np.int64).tobytes(), np.array(docs, np.int64).tobytes(),
                            np.array(variants, np.int64).tobytes(), np.array(at, np.int64).tobytes()))
            if settled:
                doc, v, a, b = (np.array(x, np.int64) for x in zip(*settled))
                out.append((hash(out[0][0]) % n_parts if out else 0, None, b.tobytes(), doc.tobytes(), v.tobytes(), a.tobytes()))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "text", "size", "doc", "v", "at"])

    return run


CONTEXTS = "part int, text binary, size binary, doc binary, v binary, at binary"


def ranges(doc: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of each document, joined where they touch, as one row."""
    order = np.lexsort((a, v, doc))
    doc, v, a, b = doc[order], v[order], a[order], b[order]
    if not len(doc):
        return
    new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])])
    group = np.cumsum(new_doc)
    far = np.int64(1) << np.int64(40)  # keeps the running end of a document below that of the next
    reach = np.maximum.accumulate(b + group * far) - group * far
    fresh = new_doc.copy()
    fresh[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    end = reach[np.append(at[1:], len(a)) - 1]
    docs = np.flatnonzero(new_doc[at])
    offsets = pa.array(np.append(docs, len(at)), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[at][docs]), pa.array(v[at][docs]), pa.ListArray.from_arrays(offsets, pa.array(a[at])), pa.ListArray.from_arrays(offsets, pa.array(end))],
        ["doc_id", "v", "a", "b"])


def context_ranges(data: bytes, size: np.ndarray, doc: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, variant, start and end of the repeated ranges of contexts that lie one after the other in ``data``.

    Of equal contexts only one is sorted, for its smallest document; to the others it is repeated as a whole.
    """
    ends = np.cumsum(size)
    index: dict[bytes, int] = {}
    same = np.fromiter((index.setdefault(data[a:b], len(index)) for a, b in zip((ends - size).tolist(), ends.tolist())), np.int64, len(size))
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    whole = doc > least[same]
    t = np.frombuffer(b"".join(index), np.uint8)
    own = np.fromiter(map(len, index), np.int64, len(index))
    n_strings = own - LENGTH + 1
    which = np.repeat(np.arange(len(own)), n_strings)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)
    hit = repeated_strings(t, (np.cumsum(own) - own)[which] + inner, least[which])
    w, i = which[hit], inner[hit]
    fresh = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (i[1:] != i[:-1] + 1)])) if len(w) else np.zeros(0, np.int64)
    last = np.append(fresh[1:], len(w))[:len(fresh)] - 1
    # ranges of distinct contexts go to the contexts of their smallest documents
    first_range = np.searchsorted(w[fresh], np.arange(len(own) + 1))
    one = np.flatnonzero(~whole)
    many = np.diff(first_range)[same[one]]
    owner = np.repeat(one, many)
    pick = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_range[same[one]], many)
    a, b = i[fresh][pick], i[last][pick] + LENGTH
    k = np.flatnonzero(whole)
    return (np.concatenate([doc[k], doc[owner]]), np.concatenate([v[k], v[owner]]),
            np.concatenate([at[k], at[owner] + a]), np.concatenate([at[k] + size[k], at[owner] + b]))


def repeated_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that a smaller document has, too."""
    for rows in by_part(batches):
        column = lambda name, some: np.concatenate([np.frombuffer(r[name], np.int64) for r in some]) if some else np.zeros(0, np.int64)
        settled, asked = [r for r in rows if r["text"] is None], [r for r in rows if r["text"] is not None]
        found = [column("doc", settled), column("v", settled), column("at", settled), column("size", settled)]
        if asked:
            found = [np.concatenate(x) for x in zip(found, context_ranges(
                b"".join([r["text"] for r in asked]), column("size", asked), column("doc", asked), column("v", asked), column("at", asked)))]
        yield from ranges(*found)


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their ranges (lists of lists ``a``, ``b``)."""
    for batch in batches:
        removed, spans, shas = [], [], []
        for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b")):
            data = (text.as_py() or "").encode()
            left, n, k, at = [], 0, 0, 0
            for x, y in sorted(zip([p for q in a.as_py() for p in q], [p for q in b.as_py() for p in q])):
                if k and x <= at:
                    n += max(0, y - at)
                    at = max(at, y)
                else:
                    left.append(data[at:x])
                    n, k, at = n + y - x, k + 1, y
            left.append(data[at:])
            removed.append(n)
            spans.append(k)
            shas.append(hashlib.sha256(b"".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("v"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())],
            ["doc_id", "v", "removed", "spans", "sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` for every row of ``docs`` (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    base = scratch_path(spark, "suffix")
    n_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = PARTS_PER_PARTITION * n_partitions

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("text"))
    slim = kept(rows.select("doc_id", "v", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "slim")
    salted = slim.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    slices = salted.groupBy("sha", "_s").agg(F.min("doc_id").alias("m"))
    firsts = slices.select("sha", "_s", F.min("m").over(Window.partitionBy("sha")).alias("first_id"))
    slim = kept(salted.join(firsts, ["sha", "_s"]).drop("_s"), "firsts")
    copies = slim.where("doc_id > first_id").select("doc_id", "v").distinct()

    real = rows.where("doc_id IS NOT NULL")
    packed = real.mapInArrow(send_anchors(n_parts), FLAGGED)
    flagged = packed.repartition(n_partitions, "part").sortWithinPartitions("part").mapInArrow(shared_anchors, "doc_id bigint, v bigint, pos array<bigint>")
    gathered = kept(flagged, "flagged").groupBy("doc_id", "v").agg(F.flatten(F.collect_list("pos")).alias("pos")).join(copies, ["doc_id", "v"], "left_anti")
    gathered = kept(gathered, "gathered")

    def with_text(wanted: DataFrame) -> DataFrame:
        ids = wanted.select("doc_id", "v").distinct()
        return real.join(small(ids), ["doc_id", "v"], "left_semi").join(wanted, ["doc_id", "v"])

    contexts = with_text(gathered).select("doc_id", "v", "text", "pos").mapInArrow(send_contexts(n_parts), CONTEXTS)
    covered = contexts.repartition(n_partitions, "part").sortWithinPartitions("part").mapInArrow(repeated_ranges, "doc_id bigint, v bigint, a array<bigint>, b array<bigint>")
    covers = kept(kept(covered, "covered").groupBy("doc_id", "v").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "covers")
    cut = kept(with_text(covers).select("doc_id", "v", "text", "a", "b").mapInArrow(cut_texts, "doc_id bigint, v bigint, removed bigint, spans bigint, sha string").distinct(), "cut")

    is_copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    joined = slim.join(cut.withColumnRenamed("sha", "cut_sha"), ["doc_id", "v"], "left")
    pick = lambda copy, cut_, else_: F.when(is_copy, copy).otherwise(F.coalesce(cut_, else_))
    return joined.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        pick(F.lit(1), F.col("spans"), F.lit(0)).cast("bigint").alias("n_spans"), pick(F.lit(nothing), F.col("cut_sha"), F.col("sha")).alias("kept_sha256"))
