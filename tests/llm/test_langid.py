import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

from probelake.llm import langid

WORDS = {"xx": "the river runs along the mill and over the stones near the bridge".split(), "yy": "der fluss zieht durch das tal und über die steine bis zur brücke".split()}


def texts(lang, n, start):
    return [(start + i, " ".join(WORDS[lang][(i * 7 + j * (i % 5 + 1)) % len(WORDS[lang])] for j in range(3 + i % 9)), lang) for i in range(n)]


def plain_model(corpus, order):
    """Interpolated Kneser-Ney straight from its formulas."""
    top = Counter()
    for w in corpus:
        s = "\0" * (order - 1) + w.lower() + "\0"
        top.update(s[i:i + order] for i in range(len(s) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    uniform = 1 / (len(levels[1]) + 1)

    def p(gram, k):
        if k == 0:
            return uniform
        counts = levels[k]
        n1, n2 = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9) if n1 + n2 else 0.5
        ctx = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
        if not ctx:
            return p(gram[1:], k - 1)
        return max(counts.get(gram, 0) - d, 0) / sum(ctx) + d * len(ctx) / sum(ctx) * p(gram[1:], k - 1)

    return lambda gram: p(gram, order)


def test_probabilities_are_those_of_the_formulas(spark):
    rows = [("xx", w) for w in WORDS["xx"]]
    counts = langid.count_grams(spark.createDataFrame(rows, "lang string, text string")).toPandas()
    models, plain = langid.CharacterModels(counts), plain_model(WORDS["xx"], langid.ORDER)
    for word in ("the", "bridge", "zebra", "qq", "e"):
        grams = langid.Grams([word])
        text = ["".join(map(chr, c)) for c in grams.chars.tolist()]
        assert len(text) == len(word) + 1
        got = models.log_probability(grams.chars)[:, 0]
        assert np.allclose(got, [math.log(plain(g)) for g in text], atol=1e-4), word
    alphabet = [chr(c) for c in {int(g[-1]) for g in langid.Grams(WORDS["xx"]).chars}]
    total = sum(plain("\0th"[:langid.ORDER - 1] + c) for c in alphabet)
    assert total <= 1 + 1e-9


def test_held_out_accuracy_and_what_is_never_learned(make):
    rows = texts("xx", 300, 0) + texts("yy", 300, 1000)
    poison = [(i, t, "zz") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, lang) for i, t, lang in rows]
    got = {r["doc_id"]: r for r in langid.identify(make(poison + [(None, "the mill", "qq"), (5000, None), (5001, "12 !? 3"), (5002, "the", None), (5003, "")])).collect()}
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert got[None]["lang_pred"] == "xx" and not got[None]["held_out"]
    for i in (5000, 5001, 5003):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[5002]["lang_pred"] == "xx"


def test_foreign_text_is_rejected_and_empty_tables_work(make):
    rows = texts("xx", 200, 0) + texts("yy", 200, 1000) + [(9000, "zqxj wvkq pfbz qqqq zzzz xjxj kwkw vvqq", None)]
    got = {r["doc_id"]: r for r in langid.identify(make(rows)).collect()}
    assert got[9000]["rejected"] and sum(r["rejected"] for r in got.values()) < 20
    assert langid.identify(make([])).count() == 0
    assert [r["lang_pred"] for r in langid.identify(make([(1, "abc", None)])).collect()] == ["und"]


def test_counts_follow_the_texts(spark):
    df = spark.createDataFrame([("xx", "ab ab-ab c"), ("xx", None), ("xx", "AB"), ("yy", "ab")], "lang string, text string")
    counts = langid.count_grams(df)
    got = {(r["lang"], r["gram"]): r["n"] for r in counts.collect()}
    want = defaultdict(int)
    for lang, words in (("xx", ["ab"] * 4 + ["c"]), ("yy", ["ab"])):
        for w in words:
            s = "\0" * 3 + w + "\0"
            for i in range(len(s) - 3):
                want[lang, s[i:i + 4]] += 1
    assert got == dict(want)


def test_ties_and_long_words():
    models = langid.CharacterModels(pd.DataFrame({"lang": ["b", "a"], "gram": ["\0\0\0x"] * 2, "n": [1, 1]}))
    names, score, _, _ = models.predict(pa.array(["x", "y" * 100_000, None]))
    assert names == ["a", "a", "und"] and score[2] == 0


def test_models_keep_every_n_gram_and_files_equal_memory(spark, make, monkeypatch):
    words = [chr(0x4E00 + i % 400) + chr(0x4E00 + i // 400) + chr(0x5200 + i % 7) for i in range(40_000)]  # over 100,000 distinct 4-grams
    rows = [("zz", " ".join(words[i::40])) for i in range(40)] + [("xx", " ".join(WORDS["xx"]))]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    counts = langid.count_grams(labelled).toPandas()
    assert (counts["lang"] == "zz").sum() > 100_000
    monkeypatch.setattr(langid, "PART_BYTES", 200_000)  # several parts
    models = langid.train(labelled, labelled.where("false"))
    assert models.grams[-1].bits > 2
    whole = langid.CharacterModels(counts)
    chars = np.concatenate([langid.characters(counts["gram"].tolist(), 4), langid.Grams(["zebra", "qq", words[5][::-1]]).chars])
    assert models.grams[-1].find(langid.hashed(chars), langid.hashed(chars[:, :-1]))[0][:len(counts)].all()
    assert np.allclose(models.log_probability(chars), whole.log_probability(chars), atol=1e-5)
    got = langid.predict(make([(1, words[7]), (2, "the mill")]), models).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "zz", 2: "xx"}


def test_every_remainder_but_two_teaches(make):
    """A language whose labels all have remainder 1 is learned, and a few documents of a language are never set aside."""
    of_one = [i for i in range(4000, 6000) if zlib.crc32(str(i).encode()) % 4 == 1][:12]
    rows = texts("xx", 300, 0) + [(i, "zoë qüxx vlørp njähr " * 3, "qq") for i in of_one]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make(rows + [(9001, "vlørp zoë", None)])).collect()}
    assert got[9001] == "qq" and all(got[i] == "qq" for i in of_one)


def test_few_documents_are_set_aside(make, monkeypatch):
    known = make(texts("xx", 300, 0) + texts("yy", 15, 1000) + texts("xx", 1, 7) * 50)
    aside = [r[0] for r in langid.set_aside(known).collect()]
    assert len(aside) == len(set(aside)) == 300 // langid.ONE_ASIDE_IN and max(aside) < 300
    monkeypatch.setattr(langid, "CALIBRATION_DOCS", 5)
    assert [r[0] for r in langid.set_aside(known).collect()] == aside[:5]


def test_loaded_files_are_bounded(monkeypatch, tmp_path):
    monkeypatch.setattr(langid, "LOADED_BYTES", 100)
    monkeypatch.setattr(langid.fs, "LocalFileSystem", type("Elsewhere", (), {}))  # files that cannot be mapped
    names = []
    for i in range(4):
        (tmp_path / f"p{i}").write_bytes(np.array([i], np.uint64).tobytes() * 4 + np.full(4, i, np.float32).tobytes())
        names.append(f"p{i}")
    table = langid.HashTable(names, 1, 2, tmp_path.as_uri())
    assert [float(table.part(i)[1][0, 0]) for i in (0, 1, 0, 2, 3, 1)] == [0, 1, 0, 2, 3, 1] and len(table.opened) <= 2
