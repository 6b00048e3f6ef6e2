import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from probelake.llm import tokenbin

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(9, " lead"), (1, "it's\n<|endoftext|> ok \xa0 z"), (2, "tab\tx\r\ny\nz "), (3, "a  b\n\n c"), (3, "a b"), (3, "a b"), (None, "x"), (None, None), (5, ""), (-4, None), (12, "z" * 20000),
        (13, "Plain words, here.\nAnd here"), (10**15, "日本 語\n\U0001F600"), (14, "\x00a b")]


def test_files_give_back_every_document(make, tmp_path, spark):
    tok = Tokenizer.from_file(PATH)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = str(tmp_path / "tokens")
    manifest = tokenbin.write(make(ROWS), PATH, 2, folder, docs_per_shard=4)
    assert manifest.count() > 1
    got = sorted(map(tuple, tokenbin.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    found = tokenbin.lookup(spark, folder, [9, 13, 77, -4, 10**15])
    assert set(found) == {9, 13, -4, 10**15}
    assert found[13] == [*tok.encode(ROWS[11][1]).ids, 2] and found[-4] == [2]


def test_empty_table(make):
    assert tokenbin.round_trip(make([]), PATH, 2).count() == 0


def test_hash_is_perfect_minimal_and_rejects_other_keys():
    rnd = np.random.default_rng(0)
    keys = np.unique(rnd.integers(-(1 << 62), 1 << 62, 50_000))
    sizes = rnd.integers(1, 900, len(keys))
    index = tokenbin.ShardIndex.unpack(tokenbin.ShardIndex.build(2, keys, 0, sizes).pack())
    slots = index.hasher.slots(tokenbin.key_hashes(keys, np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)))
    assert np.array_equal(np.sort(slots), np.arange(len(keys)))
    starts, got = index.find(keys)
    assert np.array_equal(got, sizes) and np.array_equal(starts, np.cumsum(sizes) - sizes)
    assert (index.find(keys + 1)[0][~np.isin(keys + 1, keys)] == -1).all()
    bits = sum(len(w) for w in index.hasher.levels) * 64 / len(keys)
    assert bits < 5


def test_repeated_keys_have_ordinals():
    keys = np.array([0, 0, 4, 4, 4, 9])
    ordinals, missing = tokenbin.ShardIndex.ordinals(keys, 1)
    assert ordinals.tolist() == [0, 0, 0, 1, 2, 0] and missing.tolist() == [True, False, False, False, False, False]
