"""Collocations against a brute-force count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from probelake.llm import collocations
from probelake.llm.collocations import mine


def brute(docs, max_words, least, top):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        rows = []
        for p, a in candidates.items():
            if inside[p] >= a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]], n[lang]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, r[2], r[1], r[3], r[4], r[5], r[0]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def result(spark, docs, **args):
    df = spark.createDataFrame([(i, lang, t, "x") for i, (lang, t) in enumerate(docs)], "doc_id bigint, lang string, text string, phrase string")
    return sorted(tuple(r)[:8] for r in mine(df, **args).collect())


def random_docs(n, seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "york", "a\x01", "a", "é", "È", "x-y", "ab", "\x85", "no break"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!\r\n", " ; "]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocab[:rng.choice([3, 6, 12])]) + rng.choice(ends) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("least", [2, 6])
def test_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(collocations, "SLICE_ROWS", 40)  # many slices: parts of a phrase lie in other slices
    docs = random_docs(120, least) + [("en", None), (None, ""), ("fr", "one"), ("en", "a a a a a a a a")]
    assert result(spark, docs, max_words=5, least=least, top=50) == brute(docs, 5, least, 50)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations.PhraseFilter, "holds", lambda self, h: h == h)
    docs = random_docs(60, 3)
    assert result(spark, docs, max_words=4, least=3, top=2000) == brute(docs, 4, 3, 2000)


def test_empty_and_rare(spark):
    assert result(spark, [], max_words=5, least=100, top=10) == []
    assert result(spark, [("en", "too few words")], max_words=5, least=100, top=10) == []


def test_hot_phrase_and_wide_products(spark):
    docs = [("en", "alpha beta gamma. " * 400)] * 3 + [("en", "alpha. " * 500)]
    got = result(spark, docs, max_words=5, least=100, top=10)
    assert got == brute(docs, 5, 100, 10) and got[0][2] == "alpha beta gamma"


def test_scores_past_64_bits(spark):
    row = spark.range(1).selectExpr("900000000000L a", "90000000000000L n", "910000000000L l", "920000000000L r")
    got = row.select(collocations.cut_score(*[row[c] for c in "anlr"])).first()[0]
    assert got == 1000 * 900000000000 * 90000000000000 // (910000000000 * 920000000000)
