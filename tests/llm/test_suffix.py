import hashlib

import numpy as np
import pytest

from probelake.llm import suffix


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - suffix.LENGTH + 1 if i is not None else 0):
            s = b[k:k + suffix.LENGTH]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - suffix.LENGTH + 1 if i is not None else 0):
            if least[b[k:k + suffix.LENGTH]] < i:
                gone[k:k + suffix.LENGTH] = True
        spans = int(np.sum(gone[:-1] & ~gone[1:]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", [1, 2, 5, 255])
@pytest.mark.parametrize("n", [1, 2, 60, 700])
def test_two_stage_order_is_the_order_of_the_suffixes(n, alphabet):
    t = np.random.default_rng(n).integers(0, alphabet, n).astype(np.uint8)
    if n == 700:
        t[300:420] = t[100:220]
    order = suffix.suffix_order(t)
    assert sorted(order) == list(range(n))
    keys = [bytes(t[i:i + suffix.SORTED - 1]).ljust(suffix.SORTED, b"\0") for i in order]
    assert keys == sorted(keys)
    same = suffix.adjacent_equal(np.concatenate([t, np.zeros(60, np.uint8)]), order)
    padded = bytes(t) + bytes(60)
    assert same.tolist() == [False] + [padded[a:a + 50] == padded[b:b + 50] for a, b in zip(order[:-1], order[1:])]


def test_removed_bytes_are_those_of_all_strings(make, monkeypatch):
    monkeypatch.setattr(suffix, "PORTION", 500)
    rnd = np.random.default_rng(2)
    noise = lambda n: "".join(rnd.choice(list("abcde "), n))
    passages = [noise(300) for _ in range(6)]
    rows = []
    for i in range(60):
        p, a, n = passages[rnd.integers(6)], int(rnd.integers(0, 250)), int(rnd.integers(20, 200))
        rows.append((i, noise(int(rnd.integers(0, 100))) + p[a:a + n] + noise(int(rnd.integers(0, 60)))))
    rows += [(100, None), (101, ""), (102, passages[0]), (103, passages[0]), (104, passages[0] * 2), (None, passages[0]), (105, "é" * 60), (106, "xé" * 40), (107, "é" * 30),
             (108, "a" * 500), (109, "a" * 49), (110, "a" * 50), (60, passages[1]), (60, passages[2] + "q"), (60, passages[1]), (111, noise(60000) + passages[3]), (112, "\x00" * 70), (113, "b" + "\x00" * 60)]
    got = sorted(map(tuple, suffix.remove_repeats(make(rows)).collect()), key=str)
    assert got == brute(rows)
    assert suffix.remove_repeats(make([])).count() == 0
