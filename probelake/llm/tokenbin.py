"""Binary token files with a minimal perfect hash index.

Documents are range-partitioned by key, encoded and written in ascending key order, one shard per task. A shard is
a raw payload of little-endian ids (16 or 32 bits, by vocabulary size) and an index. The index maps a document key
to a slot of its shard by a minimal perfect hash (levels of bit arrays: keys alone on a bit stay there, the others
go on to the next, smaller level; a key's slot is the rank of its bit). Each slot stores a fingerprint of its key
and the place of the document, and each word of bits its running count, so any key is answered by a few reads of a
few bytes, and keys that were never written are told apart by the fingerprint (wrong once in 2^32). Keys also stand
in order beside the hash, for reading whole shards back. Names of shards are unique to the attempt that
wrote them and enter the manifest with the task's result: a lost executor leaves at most files that nothing names.

Texts are encoded by the tokenizers library. Its byte-level pattern never joins what a single space or line feed
separates, so each worker asks the library once per distinct word and joins ids by position; a text with runs of
white space or with a special token's string is encoded as it stands.

Defined results: a null text is empty and holds the end id only; rows without a key come first; rows that share a
key are stored one after the other (ordered by text) and are told apart by their ordinal; other columns are
ignored, whatever their names. An empty table gives an empty manifest and reads back empty. Texts are written
whole, a part of a shard at a time.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelake.llm.pieces import portions
from probelake.session import scratch_path

DOCS_PER_SHARD, BYTES_PER_SHARD = 16_384, 32_000_000  # of text; the tighter one decides
KEY_CHARS = 32  # of a text that order the rows of one key between shards
TABLE_ENTRIES, TABLE_CHARS = 600_000, 12_000_000
START = "\x00"
MAGIC, VERSION = b"PLTOKIDX", 2
HEADER = struct.Struct("<8sIIQQQQ")  # magic, version, bytes an id, documents, tokens, levels, rows without key
READ_DOCS = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)

_coders: dict[str, ByteCoder] = {}


def evenly_spaced(text: str) -> bool:
    """No two characters of white space side by side, none at either end, and no zero character."""
    words = text.split()
    return sum(map(len, words)) + len(words) - 1 == len(text) and START not in text


class ByteCoder:
    """Encodes texts to packed ids; lives as long as its Python worker."""

    def __init__(self, spec: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        pre = json.loads(spec).get("pre_tokenizer") or {}
        norm = json.loads(spec).get("normalizer")
        self.cuts = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"  # of the array module, little-endian like the machine
        self.table: dict[str, bytes] = {}
        self.chars = 0
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.visible = {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}
        self.space = " ".translate(self.visible)
        self.stops = {c: self.packed([c])[0] for c in ".,"}

    def bytes_of(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        return [self.bytes_of(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Ids of new words. A run of letters is one unit of the byte-level pattern, and so is a full stop or comma
        behind it: such words go to the library's merge model directly, all others through its whole chain."""
        table, others = self.table, []
        for w in words:
            core = w[:-1] if w[-1] in ".," else w
            if not core.lstrip(START).isalpha():
                others.append(w)
                continue
            ids = table.get(core)
            if ids is None:
                body = core[1:] if core[0] == START else core
                if not body.isascii():
                    body = body.encode("utf-8").decode("latin-1").translate(self.visible)
                unit = body if core[0] == START else self.space + body
                ids = table[core] = self.bytes_of([t.id for t in self.model.tokenize(unit)])
                self.chars += len(core)
            if core is not w:
                table[w] = ids + self.stops[w[-1]]
                self.chars += len(w)
        asked = [w[1:] if w[0] == START else w if w == "\n" else " " + w for w in others]
        for w, ids in zip(others, self.packed(asked)):
            table[w] = ids
            self.chars += len(w)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        table = self.table
        if len(table) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            table.clear()
            self.chars = 0
        cut: list[list[str] | None] = []
        for text in texts:
            if not self.cuts or not text or not evenly_spaced(text) or any(s in text for s in self.special):
                cut.append(None)
            else:
                cut.append((START + text.replace("\n", f" \n {START}")).split(" "))
        new = [w for w in set().union(*[words for words in cut if words]) if w not in table]
        if new:
            self.learn(new)
        for text, words in zip(texts, cut):
            yield b"".join(map(table.__getitem__, words)) if words else self.packed([text])[0] if text else b""


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys, one function per seed."""
    with np.errstate(over="ignore"):
        z = x + MIX * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hashes(keys: np.ndarray, ordinals: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """One 64-bit number per (key, ordinal); rows without a key are numbered apart from all keys."""
    base = mixed(keys.astype(np.int64).view(np.uint64), 0)
    base = np.where(missing, np.uint64(0x5DEECE66D), base)
    return mixed(base ^ mixed(ordinals.astype(np.uint64), 1), 2)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit numbers: levels of bit words and their running counts."""

    GAMMA, MOST_LEVELS = 2, 64

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(w) * 64 for w in levels]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.starts = np.cumsum([0, *[len(w) for w in levels]])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            if len(levels) == cls.MOST_LEVELS:
                raise ValueError("two keys share a 64-bit hash")
            n_words = max(1, -(-cls.GAMMA * len(left) // 64))
            at = (mixed(left, 16 + len(levels)) % np.uint64(n_words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=n_words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of every hash; -1 where no level holds its bit."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for i, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(hashes[left], 16 + i) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[i] + at // 64, (at % 64).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        return out


class ShardIndex:
    """Keys in order and, by slot, fingerprint, first token and number of tokens."""

    def __init__(self, width: int, keys: np.ndarray, n_missing: int, hasher: PerfectHash, prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.width, self.keys, self.n_missing = width, keys, n_missing
        self.hasher, self.prints, self.starts, self.sizes = hasher, prints, starts, sizes

    @staticmethod
    def ordinals(keys: np.ndarray, n_missing: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of each row among the rows of its key (keys in order), and which rows have none."""
        missing = np.arange(len(keys)) < n_missing
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (missing[1:] != missing[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
        return np.arange(len(keys)) - first, missing

    @classmethod
    def build(cls, width: int, keys: np.ndarray, n_missing: int, sizes: np.ndarray) -> ShardIndex:
        hashes = key_hashes(keys, *cls.ordinals(keys, n_missing))
        hasher = PerfectHash.build(hashes)
        slot = hasher.slots(hashes)
        out = cls(width, keys, n_missing, hasher, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64))
        out.prints[slot] = mixed(hashes, 3).astype(np.uint32)
        out.starts[slot] = np.cumsum(sizes) - sizes
        out.sizes[slot] = sizes
        return out

    def find(self, keys: np.ndarray, ordinals: np.ndarray | int = 0, missing: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First token and number of tokens of every key; -1 and 0 for keys that the shard does not hold."""
        ordinals, missing = np.broadcast_to(ordinals, keys.shape), np.broadcast_to(missing, keys.shape)
        hashes = key_hashes(keys, ordinals, missing)
        slot = self.hasher.slots(hashes)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == mixed(hashes[known], 3).astype(np.uint32)
        at = np.where(known, slot, 0)
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        return np.where(known, self.starts[at], -1), np.where(known, self.sizes[at], 0)

    def pack(self) -> bytes:
        lengths = np.array([len(w) for w in self.hasher.levels], "<u8")
        head = HEADER.pack(MAGIC, VERSION, self.width, len(self.keys), int(self.sizes.sum()), len(lengths), self.n_missing)
        parts = [lengths, self.hasher.words.astype("<u8"), self.hasher.before[:-1].astype("<u8"), self.keys.astype("<i8"), self.starts.astype("<i8"), self.sizes.astype("<i8"),
                 self.prints.astype("<u4")]
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> ShardIndex:
        magic, version, width, n, _, n_levels, n_missing = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not an index of token files")
        at = HEADER.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        lengths = take(n_levels, "<u8").astype(np.int64)
        words = take(int(lengths.sum()), "<u8")
        take(len(words), "<u8")  # running counts, for single lookups
        levels = np.split(words, np.cumsum(lengths)[:-1]) if n_levels else []
        keys, starts, sizes = take(n, "<i8"), take(n, "<i8"), take(n, "<i8")
        return cls(width, keys, n_missing, PerfectHash(levels), take(n, "<u4"), starts, sizes)


class StoredIndex:
    """Single lookups in an index file: one word and one count for each level tried, then one slot; nothing else is read."""

    def __init__(self, file):
        self.file = file
        magic, version, self.width, self.n, _, n_levels, _ = HEADER.unpack(file.read_at(HEADER.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not an index of token files")
        self.lengths = np.frombuffer(file.read_at(8 * n_levels, HEADER.size), "<u8").astype(np.int64)
        self.words_at = HEADER.size + 8 * n_levels
        n_words = int(self.lengths.sum())
        self.before_at = self.words_at + 8 * n_words
        self.starts_at = self.before_at + 8 * n_words + 8 * self.n
        self.sizes_at, self.prints_at = self.starts_at + 8 * self.n, self.starts_at + 16 * self.n

    def number(self, at: int, kind: str) -> int:
        kind = np.dtype(kind)
        return int(np.frombuffer(self.file.read_at(kind.itemsize, at), kind)[0])

    def find(self, key: int, ordinal: int = 0) -> tuple[int, int]:
        """First token and number of tokens; -1 and 0 for a key that the shard does not hold."""
        h = key_hashes(np.array([key]), np.array([ordinal]), np.array([False]))
        level_at = 0
        for i, n_words in enumerate(self.lengths):
            at = int(mixed(h, 16 + i)[0] % np.uint64(n_words * 64))
            word = level_at + at // 64
            value = self.number(self.words_at + 8 * word, "<u8")
            if value >> (at % 64) & 1:
                slot = self.number(self.before_at + 8 * word, "<u8") + (value & ((1 << (at % 64)) - 1)).bit_count()
                if self.number(self.prints_at + 4 * slot, "<u4") != int(mixed(h, 3).astype(np.uint32)[0]):
                    return -1, 0
                return self.number(self.starts_at + 8 * slot, "<i8"), self.number(self.sizes_at + 8 * slot, "<i8")
            level_at += int(n_words)
        return -1, 0


def store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "place int, name string, first_key bigint, n_docs bigint, n_tokens bigint, width int"


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, docs_per_shard: int = DOCS_PER_SHARD, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) as shards below ``folder``; the manifest, one row per shard, is written last.

    ``folder`` must be reachable from every executor. Rows of one key may go on in the next shard: shards are cut by key
    and the first characters of the text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; tasks get its content
        spec = f.read()
    spark = docs.sparkSession
    spec_key = hashlib.sha256(spec.encode()).hexdigest()
    shared_spec = spark.sparkContext.broadcast(spec)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if spec_key not in _coders:
            _coders[spec_key] = ByteCoder(shared_spec.value)
        coder = _coders[spec_key]
        end = np.array([end_id], coder.kind).tobytes()
        name, out, keys, sizes, n_missing = f"shard-{uuid.uuid4().hex}", None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files, path = store(folder)
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(f"{path}/{name}.ids")
            ids = batch.column("doc_id")
            n_missing += ids.null_count
            keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
            texts = (x.as_py() or "" for x in batch.column("text"))
            for packed in (x for part in portions(texts) for x in coder.encode(part)):
                out.write(packed)
                out.write(end)
                sizes.append(len(packed) // coder.kind.itemsize + 1)
        if out is None:
            return
        out.close()
        index = ShardIndex.build(coder.kind.itemsize, np.concatenate(keys), n_missing, np.array(sizes, np.int64))
        with files.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(index.pack())
        first = None if n_missing else int(index.keys[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([first], pa.int64()), pa.array([len(index.keys)]), pa.array([int(sum(sizes))]), pa.array([coder.kind.itemsize], pa.int32())],
            ["place", "name", "first_key", "n_docs", "n_tokens", "width"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_shards = max(1, -(-n_rows // docs_per_shard), -(-n_bytes // bytes_per_shard))
    sorted_rows = rows.repartitionByRange(n_shards, "doc_id", F.substring("text", 1, KEY_CHARS)).sortWithinPartitions("doc_id", "text")
    manifest = f"{folder}/manifest.parquet"
    sorted_rows.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.parquet(manifest)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files alone.

    Keys come from the index in order, each is looked up by hash, and its ids are read at the place found.
    """
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    order = Window.orderBy("place")  # one row per shard
    based = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = store(folder)
                with files.open_input_file(f"{path}/{row['name']}.idx") as f:
                    index = ShardIndex.unpack(f.read())
                kind = np.dtype(f"<u{index.width}")
                ordinals, missing = ShardIndex.ordinals(index.keys, index.n_missing)
                with files.open_input_file(f"{path}/{row['name']}.ids") as f:
                    for a in range(0, len(index.keys), READ_DOCS):
                        part = slice(a, a + READ_DOCS)
                        starts, sizes = index.find(index.keys[part], ordinals[part], missing[part])
                        if (starts < 0).any():
                            raise ValueError(f"{row['name']}: a stored key is not found")
                        crc = [zlib.crc32(np.frombuffer(f.read_at(int(s) * index.width, int(p) * index.width), kind).astype("<u4").tobytes()) for p, s in zip(starts, sizes)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.keys[part], pa.int64(), mask=missing[part]), pa.array(starts + row["base"]), pa.array(sizes), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents by key, on the caller's side: the manifest once, then a few numbers of an index and one payload for each key.

    Of several rows of a key the first in its first shard is answered.
    """
    rows = spark.read.parquet(f"{folder}/manifest.parquet").orderBy("place").collect()  # one row per shard
    first = [r["first_key"] if r["first_key"] is not None else -(1 << 63) for r in rows]
    files, path = store(folder)
    out = {}
    for key in keys:
        near = (bisect_left(first, key) - 1, bisect_left(first, key))  # a key can begin in the shard before the one it is first in
        for k in (k for k in near if 0 <= k < len(rows)):
            name = rows[k]["name"]
            with files.open_input_file(f"{path}/{name}.idx") as f:
                index = StoredIndex(f)
                start, size = index.find(key)
            if start >= 0:
                with files.open_input_file(f"{path}/{name}.ids") as f:
                    out[key] = np.frombuffer(f.read_at(size * index.width, start * index.width), f"<u{index.width}").tolist()
                break
    return out


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write to a fresh shared folder and read back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, end_id, folder)
    return read(docs.sparkSession, folder)
