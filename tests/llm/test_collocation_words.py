"""Words and their hashes, whole columns at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from probelake.llm.collocations import tokens, word_hashes


def test_hashes_of_a_column():
    words = pa.array(["", "\x00", "\x00\x00", "a", "b", "ab", "ba", "aab", "é", "é", *[f"w{i}" for i in range(20000)]])
    h = word_hashes(words)
    assert h.dtype == np.uint64 and len(np.unique(h)) == len(words)
    assert (word_hashes(words.slice(4, 9)) == h[4:13]).all() and (word_hashes(words.cast(pa.large_string())) == h).all()
    assert len(word_hashes(pa.array([], pa.string()))) == 0 and len(word_hashes(pa.array(["", ""]))) == 2


def test_runs_of_blanks_make_no_words():
    texts = ["", None, " \t ", "A" + " " * 100 + "b\t \tc,,;. x", " \n \x0b y ", "." * 9, "z" * 50 + " " * 17 + "\t" * 9 + "q", "A\x85B  c d"]
    words, which, row, piece = tokens(pa.array(texts))
    got = {}
    for w, r, p in zip(words.take(pa.array(which)).to_pylist(), row.tolist(), piece.tolist()):
        got.setdefault((r, p), []).append(w)
    want = [(i, ws) for i, t in enumerate(texts) for part in re.split("[.,;:!?\x0a-\x0d]", (t or "").replace("A", "a").replace("B", "b")) if (ws := re.findall("[^\x20\x09]+", part))]
    assert [(r, ws) for (r, _), ws in got.items()] == want
