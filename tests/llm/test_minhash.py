import random
import re

import numpy as np
import pyarrow as pa
import pytest

from probelake.llm import graph, minhash


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(shingles(t))
    ids = [i for i in by_id if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in by_id[a] for y in by_id[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows), key=str)


def family(rnd, base, n, edits):
    """Copies of one text with some words replaced: many are near the first, few near each other."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("piece", [256, 7])
def test_components_are_those_of_all_pairs(make, monkeypatch, piece):
    monkeypatch.setattr(minhash, "QUERY_PIECE", piece)
    monkeypatch.setattr(minhash, "BUCKET_PIECE", piece)
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = []
    for n, edits in ((60, 8), (25, 3), (12, 14), (5, 1)):
        texts += family(rnd, [word() for _ in range(150)], n, edits)
    shared = " ".join(word() for _ in range(40))
    texts += [f"{' '.join(word() for _ in range(60))} {shared}" for _ in range(20)] + [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(30)]
    texts += [texts[0].upper(), texts[3] + "\n", "One two", "one TWO", "", None, " \n", "É É", "é é", "solo"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(map(tuple, minhash.near_groups(make(rows)).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_repeated_and_missing_ids_empty_tables_and_kept_rows(make):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(7, a), (7, b), (9, a + " more"), (3, b), (3, b), (None, a), (None, None), (4, "x" * 20000), (5, None)]
    docs = make(rows)
    got = sorted(map(tuple, minhash.near_groups(docs).collect()), key=str)
    assert got == brute(rows)
    stays = minhash.drop_near_copies(docs)
    assert stays.columns == docs.columns
    assert sorted((r["doc_id"] for r in stays.collect()), key=str) == [3, 3, 4, 5, None, None]
    assert minhash.near_groups(make([])).count() == 0


def test_estimate_is_unbiased_and_never_rules_out_a_pair_at_the_threshold():
    rnd = np.random.default_rng(1)
    k = minhash.BANDS * minhash.ROWS
    factors, counts = minhash.random_odd(k), []
    for _ in range(60):
        pool = rnd.integers(1, 1 << 62, 700, dtype=np.uint64)
        sets = [np.sort(pool[:600]), np.sort(pool[100:])]  # 500 common of 700
        planes = minhash.bit_planes(minhash.minima(sets, factors)).view(np.uint64)
        words = k // 64
        apart = sum(int(np.bitwise_count(np.bitwise_or.reduce([planes[0, j * words + w] ^ planes[1, j * words + w] for j in range(minhash.BITS)]))) for w in range(words))
        counts.append(k - apart)
    chance = 0.5**minhash.BITS
    assert abs((np.mean(counts) / k - chance) / (1 - chance) - 500 / 700) < 0.02
    assert min(counts) >= minhash.agreements_needed()


def test_long_text_and_short_texts_have_exact_set_sizes():
    texts = ["a b c d e f", "a b c d e a b c d e", "a", "", None, " ".join(str(i % 5000) for i in range(40000))]
    assert [len(s) for s in minhash.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_components_of_a_chain_a_hub_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 4), (4, None)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200, 202: 200}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
