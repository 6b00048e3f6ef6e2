import zlib

import pytest

from probelake.llm import sharding


def greedy(sizes, capacity):
    shards, at = [], 0
    number = 0
    for s in sizes:
        if at + s > capacity and at:
            number, at = number + 1, 0
        at += s
        shards.append(number)
    return shards


def brute(rows, n):
    units = {}
    firsts = {}
    for i, t in rows:
        firsts[t] = min(firsts.get(t, i), i)
    for i, t in rows:
        units[firsts[t]] = units.get(firsts[t], 0) + len((t or "").encode()) + sharding.OVERHEAD
    keys = sorted(units)
    sizes = [units[k] for k in keys]
    capacity = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c)[-1] < n)
    shard = dict(zip(keys, greedy(sizes, capacity)))
    return {i: shard[firsts[t]] for i, t in rows}


def some(n, spread):
    return [((i * 37 % n) * spread, "t" * (i * 7919 % 97) if i % 5 else f"copy {i % 3}") for i in range(n)] + [(n * spread + 1, None), (n * spread + 2, "ü" * 40)]


@pytest.mark.parametrize("spread,n_shards", [(1, 24), (10**14, 5)])
def test_capacity_and_cuts_are_those_of_the_greedy_walk(make, spread, n_shards):
    rows = some(300, spread)
    got = sharding.shard_by_bytes(make(rows), n_shards).collect()
    want = brute(rows, n_shards)
    assert {r["doc_id"]: r["shard"] for r in got} == want
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "bytes", None)
    for s in set(want.values()):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(v == s for v in want.values())))


def test_hot_group_repeated_ids_missing_ids_and_empty_tables(make):
    rows = [(i, "the same text") for i in range(200)] + [(i, f"own {i}") for i in range(200, 230)] + [(5, "other"), (5, "other"), (None, "lost"), (None, None)]
    got = sharding.shard_by_bytes(make(rows), 24).collect()
    assert len(got) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] != 5}) == 1
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(make([]), 24).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharding.shard_by_bytes(make([(3, "x")]), 24).collect()] == [(0, 0)]
