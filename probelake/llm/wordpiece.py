"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary becomes a trie. Every state knows where to go on when no child fits (its failure link) and how many
pieces are popped on the way, both worked out beforehand, so a word is counted in one pass over its characters and
no piece is ever built. Words of a batch are made distinct first and walk through the automaton side by side, one
character a step, on sorted arrays of (state, character) keys.

Semantics: a text is cut at white space; at each place of a word the longest piece of the vocabulary is taken
(pieces with ``mark`` in front at the word's start, bare ones elsewhere); a word with a place where none fits
counts as one unknown token.

Defined results: a null or empty text has no words and no tokens; other columns are ignored, whatever their names;
an empty table gives an empty result; words and texts of any length are counted whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from probelake.llm.batches import by_bytes

SPACE = r"[\x20\x09-\x0D]+"
CHAR_BITS = 21
DEAD = -1
_machines: dict[str, Automaton] = {}


class Automaton:
    """Trie over pieces with failure links and popped counts. State 0 is a word's start, state 1 its continuation."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        children: list[dict[str, int]] = [{}, {}]
        ends = {}
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                at = root
                for ch in piece:
                    nxt = children[at].get(ch)
                    if nxt is None:
                        nxt = children[at][ch] = len(children)
                        children.append({})
                    at = nxt
                if at != root:
                    ends[at] = True
        n = len(children)
        fail, pops = np.full(n, DEAD, np.int64), np.zeros(n, np.int64)
        order = [0, 1]
        for at in order:  # breadth first
            for ch, to in children[at].items():
                if to in ends:
                    fail[to], pops[to] = 1, 1
                else:
                    # pop what the failure links of the parent pop until some state can read the character
                    z, popped = fail[at], pops[at]
                    while z != DEAD and ch not in children[z]:
                        popped, z = popped + pops[z], fail[z]
                    if z != DEAD:
                        fail[to], pops[to] = children[z][ch], popped
                order.append(to)
        self.fail, self.pops = fail, pops
        keys = np.array([(at << CHAR_BITS) | ord(ch) for at, kids in enumerate(children) for ch in kids], np.int64)
        goal = np.array([to for kids in children for to in kids.values()], np.int64)
        rank = np.argsort(keys)
        self.keys, self.goal = keys[rank], goal[rank]

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each state for its character, or DEAD."""
        key = (state << CHAR_BITS) | char
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.goal[i], DEAD)

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word (none empty); 0 for a word that cannot be cut."""
        n = len(words)
        out = np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        chars = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # words longer than t
            at = np.flatnonzero(state[:live] != DEAD)
            char = chars[starts[at] + t]
            while len(at):
                now = state[at]
                to = self.step(now, char)
                hit = to != DEAD
                state[at[hit]] = to[hit]
                at, char, now = at[~hit], char[~hit], now[~hit]
                total[at] += self.pops[now]
                state[at] = self.fail[now]
                going = state[at] != DEAD
                at, char = at[going], char[going]
        # what is left at the end is popped until the continuation state is reached
        at = np.flatnonzero((state != DEAD) & (state != 1))
        while len(at):
            now = state[at]
            total[at] += self.pops[now]
            state[at] = self.fail[now]
            at = at[(state[at] != DEAD) & (state[at] != 1)]
        out[order] = np.where(state == 1, total, 0)
        return out


def vocabulary(model_path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Word-start and inner pieces of a SentencePiece model file, in its order; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    initial = [p[len(mark):] for p in plain if p.startswith(mark) and len(p) > len(mark)]
    inner = [p for p in plain if mark not in p]
    return [p for p in initial if mark not in p], inner


def count_tokens(docs: DataFrame, initial: list[str], inner: list[str]) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_unknown``, ``n_tokens`` for every row of ``docs`` (``doc_id``, ``text``)."""
    key = hashlib.sha256("\n".join([*initial, "", *inner]).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _machines:
            _machines[key] = Automaton(initial, inner)
        machine = _machines[key]
        for batch in by_bytes(batches):
            lists = pc.split_pattern_regex(pc.fill_null(batch.column("text"), ""), SPACE)
            coded = pc.dictionary_encode(lists.flatten())
            distinct = coded.dictionary.to_pylist()
            filled = np.array([w != "" for w in distinct], bool)
            pieces = np.zeros(len(distinct), np.int64)
            pieces[filled] = machine.count([w for w in distinct if w])
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            sums = lambda v: np.bincount(row, weights=v[which] if len(which) else [], minlength=batch.num_rows).astype(np.int64)
            unknown = filled & (pieces == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sums(filled)), pa.array(sums(unknown)), pa.array(sums(pieces + unknown))],
                ["doc_id", "n_words", "n_unknown", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_unknown bigint, n_tokens bigint")
