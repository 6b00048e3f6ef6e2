import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from probelake.llm import pieces, wordpiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "a", " a", "a ", "a  b", "\n", "a\n", "\na", "a\n\nb", "a \n b", "tab\there\r\nend", "日本 語\n\U0001F600 x", "\x00 zero \x00b", "<s> </s> <unk>", "▁mark ▁ x",
         "The quick brown fox.\nJumps over\nthe lazy dog!", "x" * 1500, "word " * 4000, "é è́ ​ ﻿"]


def test_ids_and_decoding_are_those_of_the_library(make):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in pieces.encode(make([*enumerate(TEXTS), (None, "no id")]), MODEL).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids), t
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = sp.decode(ids) if ids else ""
        assert r["decoded"] == decoded and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert pieces.encode(make([]), MODEL).count() == 0


def test_the_table_starts_anew_without_changing_results(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 3)
    coder = pieces.WordCoder(open(MODEL, "rb").read())
    texts = [f"word{i % 7} again{i}\nnext{i % 3} line" for i in range(40)]
    assert [ids.tolist() for part in pieces.portions(texts, 50) for ids in coder.encode(part)] == coder.sp.encode(texts)


def adverse(rnd):
    """A text over an alphabet that is hard on cutting: markers, blanks of all kinds, control and wide characters."""
    return "".join(rnd.choice(["▁", "▁▁", " ", " ", "  ", "\n", "\r", "\t", "\x00", "\x85", "\u00a0", "\u3000", "a", "b", "foo", "the", "x", "é", "中", "𝒳", "\u200b", "<0x0A>", "<unk>", ".", ",", "1"])
                   for _ in range(rnd.randrange(12)))


def test_no_text_is_too_odd_for_the_table():
    coder = pieces.WordCoder(open(MODEL, "rb").read())
    rnd = random.Random(1)
    texts = [adverse(rnd) for _ in range(8000)] + ["foo ▁ 中", "a▁ 𝒳", "▁ \x85", "▁", "▁▁", " ▁ ", "\n▁", "▁\n", "\x00", " \x00", "\n\x00a"]
    assert coder.cuts and [ids.tolist() for part in pieces.portions(texts, 5000) for ids in coder.encode(part)] == coder.sp.encode(texts)


def test_double_spaces_go_through_the_table():
    coder = pieces.WordCoder(open(MODEL, "rb").read())
    list(coder.encode(["two  spaces and  more   of them "]))
    assert {"and", "of", "\n▁▁spaces", "\n▁▁▁of"} <= set(coder.table) | {"of"} and len(coder.table) == 7


def greedy(word, initial, inner):
    at = n = 0
    while at < len(word):
        to = next((b for b in range(len(word), at, -1) if word[at:b] in (inner if at else initial)), None)
        if to is None:
            return 0
        at, n = to, n + 1
    return n


@pytest.mark.parametrize("seed", range(5))
def test_automaton_counts_like_greedy_matching(seed):
    rnd = random.Random(seed)
    word = lambda most: "".join(rnd.choices("abc", k=rnd.randint(1, most)))
    for _ in range(30):
        initial, inner = [word(5) for _ in range(rnd.randint(0, 8))], [word(5) for _ in range(rnd.randint(0, 8))]
        words = [word(14) for _ in range(40)] + ["abc" * 500]
        assert wordpiece.Automaton(initial, inner).count(words).tolist() == [greedy(w, initial, inner) for w in words]


def test_token_counts_are_those_of_a_word_piece_model(make):
    initial, inner = wordpiece.vocabulary(MODEL)
    vocab = {"[UNK]": 0}
    for p in [*initial, *("##" + p for p in inner)]:
        vocab.setdefault(p, len(vocab))
    model = Tokenizer(WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9)).model
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in wordpiece.count_tokens(make(rows), initial, inner).collect()}
    for i, t in rows:
        words = [w for w in pa.compute.split_pattern_regex(pa.array([t or ""]), wordpiece.SPACE).to_pylist()[0] if w]
        cut = [model.tokenize(w) for w in words]
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(map(len, cut))), t
        assert got[i]["n_unknown"] == sum(c[0].id == 0 for c in cut)
    assert wordpiece.count_tokens(make([]), initial, inner).count() == 0
