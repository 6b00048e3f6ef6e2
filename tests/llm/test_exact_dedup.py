import hashlib

import pytest

from probelake.llm import exact_dedup


def brute(rows):
    texts = [(i, t or "") for i, t in rows]
    out = []
    for i, t in texts:
        same = [j for j, u in texts if u == t]
        known = [j for j in same if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "Some words stand here. " * 2000
ROWS = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, LONG + "x"), (8, "a b c "), (8, "a b c "), (None, "a b c"),
        (None, "alone"), (9, "line\nline\n" * 90), (10, "line\nline\n" * 90), (11, "日本語。" * 700), (12, "日本語。" * 700), (13, "\U0001F600" * 5000)]


@pytest.mark.parametrize("id_bits", [64, 2])
def test_same_as_brute_force_even_if_chunk_identifiers_collide(make, id_bits):
    got = exact_dedup.mark_copies(make(ROWS), id_bits).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_chunks_join_to_the_text_and_survive_an_insertion(spark, make):
    a, b = "".join(f"Sentence number {i} is here. " for i in range(400)), ""
    b = "New words in front. " + a
    rows = make([(1, a), (2, b), (3, "")]).select("doc_id", exact_dedup.chunks("text").alias("c")).collect()
    chunks = {r["doc_id"]: r["c"] for r in rows}
    assert "".join(chunks[1]) == a and "".join(chunks[2]) == b and chunks[3] == []
    assert len(set(chunks[1]) & set(chunks[2])) > 0.5 * len(chunks[1])


def test_empty_table_and_columns_of_the_kept_rows(make):
    assert exact_dedup.mark_copies(make([])).count() == 0
    docs = make(ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {4, 6, 7, 2, 8, 10, 12, 13, None}
