"""SentencePiece encoding and decoding with a table of distinct marked words.

A text is one string in which every space is a marker, with a marker in front. When no piece of a model has a marker
behind another character, and none holds a line feed, no piece crosses from a character to the marker behind it or
over a line feed: the text falls apart there, and each run of markers with the characters behind it, a marked word,
is segmented on its own. This holds for runs of spaces, spaces at either end and markers written out in the text as
well: they make marked words with more markers. Both properties are read from the vocabulary; a model without them is
encoded text by text. Every worker keeps a table from marked word to ids, asks the library once per distinct word,
and joins the ids back by position. Nothing is shuffled: a table for the whole corpus would move every word occurrence
twice, many times the text itself. Results leave a task in portions of about ``PORTION_CHARS`` characters.

Defined results: a null text counts as empty and has no ids; other columns are ignored, whatever their names; an
empty table gives an empty result; texts of any length are encoded whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probelake.llm.batches import by_bytes, hold_batches

TABLE_ENTRIES, TABLE_CHARS = 200_000, 4_000_000  # what a worker remembers; beyond either the table starts anew
PORTION_CHARS = 1_000_000  # text whose new words go to the library at once
MARK = "▁"
START = "\x00"  # put before a word that no marker precedes
# A text with none of these has one marker before each word: splitting at spaces finds the marked words. In others they
# are found one by one: a line feed, or markers with the characters behind them.
UNEVEN = re.compile(f" (?=[ \n])|\n |^[ \n]| $|\x00|{MARK}")
MARKED = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
COLUMNS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}

_coders: dict[str, WordCoder] = {}


def marked_words(text: str) -> list[str]:
    """Table keys of a text of any shape, in order.

    A word behind one marker is its own key, a line feed is one. All else, and words that look like a key of another
    kind, are spelled with their markers behind a line feed.
    """
    found = MARKED.findall(MARK + text.replace(" ", MARK))
    return [w if w == "\n" else w[1:] if len(w) > 1 and w[0] == MARK and w[1] not in (MARK, START) else "\n" + w for w in found]


class WordCoder:
    """Encodes and decodes with one model; lives as long as its Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        joins = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        spells_bytes = any(self.sp.is_byte(i) for i in range(len(pieces)))  # else unknown characters side by side are one id
        self.cuts = spells_bytes and not joins
        self.table: dict[str, bytes] = {}
        self.chars = 0
        self.decimal = [str(i) for i in range(len(pieces))]
        self.lead = len(self.sp.encode("\n"))  # ids of a marker and a line feed

    def learn(self, words: list[str]) -> None:
        """The library puts a marker before the word itself, as a space would; a word that no single marker precedes is
        encoded behind a line feed, whose ids are then taken off."""
        asked = ["\n" + w[1:] if w[0] == START else w for w in words]
        for w, ids in zip(words, self.sp.encode(asked, num_threads=1)):
            if w == "\n":
                ids = ids[1:]
            elif w[0] in (START, "\n"):
                ids = ids[self.lead:]
            self.table[w] = array("i", ids).tobytes()
            self.chars += len(w)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        table = self.table
        if len(table) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            table.clear()
            self.chars = 0
        cut: list[list[str] | None] = []
        for text in texts:
            if not self.cuts or not text:
                cut.append(None)
                continue
            if UNEVEN.search(text):
                cut.append(marked_words(text))
                continue
            words = text.replace("\n", f" \n {START}").split(" ")
            if words[-1] == START or "\n\n" in text:
                words = [w for w in words if w != START]
            cut.append(words)
        new = [w for w in set().union(*[words for words in cut if words]) if w not in table]
        if new:
            self.learn(new)
        for text, words in zip(texts, cut):
            if words is None:
                yield np.array(self.sp.encode(text) if text else [], np.int32)
            else:
                yield np.frombuffer(b"".join(map(table.__getitem__, words)), np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""

    def spelled(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))


def portions(texts: Iterable[str], chars: int = PORTION_CHARS) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def coder(key: str, model: bytes) -> WordCoder:
    if key not in _coders:
        _coders[key] = WordCoder(model)
    return _coders[key]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(docs: DataFrame, model_path: str, columns: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    """``doc_id`` and the asked ``columns`` (see ``COLUMNS``) for every row of ``docs`` (``doc_id``, ``text``)."""
    with open(model_path, "rb") as f:  # on the driver; tasks get the bytes
        model = f.read()
    key = sha(model)
    wanted = list(columns)
    decodes = any(c.startswith("decoded") for c in wanted)
    hold_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(key, model)
        for batch in by_bytes(batches, size=PORTION_CHARS):
            coded = list(c.encode([x or "" for x in batch.column("text").to_pylist()]))
            out: dict[str, list] = {n: [] for n in wanted if n not in ("n_tokens", "ids")}
            for ids in coded if out else ():
                one = ids.tolist()
                decoded = c.decode(one) if decodes else ""
                for n, values in out.items():
                    values.append(sha(c.spelled(one).encode()) if n == "ids_sha256" else decoded if n == "decoded" else sha(decoded.encode()))
            sizes = np.array([len(ids) for ids in coded], np.int64)
            made = {n: pa.array(values, pa.string()) for n, values in out.items()}
            made["n_tokens"] = pa.array(sizes)
            if "ids" in wanted:
                made["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(coded)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[made[n] for n in wanted]], ["doc_id", *wanted])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} {COLUMNS[n]}" for n in wanted]]))
