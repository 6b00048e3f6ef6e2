"""Spelling variants against a brute-force search over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from probelake.llm.spelling import Acceptor, group_variants, partition_pairs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def words_of(docs, min_chars=7, min_n=2, one_in=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_n}


def brute(docs, ratio=10, **args):
    n = words_of(docs, **args)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def result(make, docs, **args):
    return sorted(tuple(r) for r in group_variants(make(docs), **args).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_acceptor_ranks_are_sorted_places():
    words = sorted({"", "a", "ab", "abc", "bbc", "bc", "c" * 3000})
    a = Acceptor(words)
    assert a.size[a.start] == len(words) and len(a.size) < sum(map(len, words)) + 2


@pytest.mark.parametrize("seed", range(30))
def test_partition_pairs_are_all_pairs(seed):
    rng = random.Random(seed)
    lo, hi, tail = rng.choice([(0, 2, 1), (1, 3, 0), (2, 5, 2), (0, 1, 3)])
    chars = hi + tail
    words = sorted({"".join(["x" * lo, *rng.choices("abx", k=hi - lo + rng.randrange(2)), "x" * tail]) for _ in range(60)})
    place = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b) and min(len(a), len(b)) == chars
            and (lo <= place(a, b) < hi or (hi == chars and place(a, b) == chars))}
    rng.shuffle(words)
    got = [tuple(sorted((words[i], words[j]))) for i, j in partition_pairs(words, lo, hi, chars)]
    assert sorted(got) == sorted(want)


def random_docs(n, seed, letters="abcDé×"):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randrange(5, 12))) for _ in range(25)]

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]])
        return w

    return [(i, " 1,".join(word() for _ in range(rng.randrange(40)))) for i in range(n)]


@pytest.mark.parametrize("group", [20_000, 3])
def test_equals_brute_force(make, group):
    docs = random_docs(120, group) + [(900, None), (901, ""), (None, "abcabcabc abcabcabc"), (5, "abcabcabc")]
    got = result(make, docs, group_words=group)
    assert got == brute(docs) and any(r[4] > 1 for r in got)


def test_short_words_and_few_chars(make):
    docs = random_docs(40, 7, "ab")
    assert result(make, docs, min_chars=2, min_n=1, ratio=1 << 40, group_words=4) == brute(docs, min_chars=2, min_n=1, ratio=1 << 40)


def test_chain_of_forms(make):
    words = {"abcdefgh": 2, "abcdefg": 30, "abcdefgx": 400, "abcdefxx": 5000}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items(), 1000)]
    got = {r[0]: r for r in result(make, docs, one_in=1 << 40)}
    assert got["abcdefgh"][1:3] == ("abcdefgx", "abcdefxx") and got["abcdefg"][1:3] == ("abcdefgx", "abcdefxx")
    assert got["abcdefxx"][1:] == (None, "abcdefxx", 5000, 1, None)
    assert sorted(got.values()) == brute(docs, one_in=1 << 40)


def test_hot_prefix_and_long_words(make):
    rng = random.Random(1)
    words = ["prefix" + "".join(rng.choices("abcdef", k=4)) for _ in range(300)] + ["q" * 50_000, "q" * 50_001, "q" * 25_000 + "z" + "q" * 25_000]
    docs = [(i, f"{w} {w}") for i, w in enumerate(words)]
    assert result(make, docs, group_words=10, group_chars=60_000) == brute(docs)


def test_empty(make):
    assert result(make, []) == []
