"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces: from each point of a word the longest vocabulary entry is taken. The
vocabulary is a trie; every node has a failure link and the number of pieces that following it completes,
so a word's piece count comes from one pass over its characters, with no backtracking and no piece ever built.

Defined results: words are the runs between blanks of the whole text; null and empty texts have 0 words and
0 tokens; a word that the vocabulary can't spell counts as one unknown token; vocabulary entries that repeat are one, and of entries
that tie at a place the longest is taken; repeated rows are counted each on its own; an empty table gives an empty result; very long
texts and words cost in proportion to their length.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, tidy, utf8

END = 256
UNKNOWN = -1


class LongestMatch:
    """Piece counts of byte strings. ``first`` starts a word, ``later`` continues it; None: the same entries."""

    def __init__(self, first: Iterable[tuple[int, ...]], later: Iterable[tuple[int, ...]] | None = None):
        self.child: list[dict[int, int]] = [{}]
        self.token: list[bool] = [False]
        self.root = self.more = 0
        self._insert(0, first)
        if later is not None:
            self.more = self._node()
            self._insert(self.more, later)
        self.fail, self.pops = [UNKNOWN] * len(self.child), [0] * len(self.child)
        self._link()

    def _node(self) -> int:
        self.child.append({})
        self.token.append(False)
        return len(self.child) - 1

    def _insert(self, root: int, entries: Iterable[tuple[int, ...]]) -> None:
        for entry in entries:
            at = root
            for c in entry:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = self._node()
                at = nxt
            if at != root:
                self.token[at] = True

    def _link(self) -> None:
        """Breadth first: a token's node pops itself and continues at ``more``; any other node first pops what
        its parent pops, then goes on popping until the last symbol can be followed."""
        queue = deque({self.root, self.more})
        while queue:
            u = queue.popleft()
            for c, v in self.child[u].items():
                if self.token[v]:
                    self.fail[v], self.pops[v] = self.more, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z != UNKNOWN and c not in self.child[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != UNKNOWN:
                        self.fail[v], self.pops[v] = self.child[z][c], popped
                queue.append(v)

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of one word; 1 if it can't be spelled."""
        child, fail, pops, at, n = self.child, self.fail, self.pops, self.root, 0
        for c in symbols:
            while (nxt := child[at].get(c)) is None:
                if fail[at] == UNKNOWN:
                    return 1
                n += pops[at]
                at = fail[at]
            at = nxt
        while at != self.more and at != self.root:
            if fail[at] == UNKNOWN:
                return 1
            n += pops[at]
            at = fail[at]
        return n


def byte_of_char() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies, from their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def entries(path: str) -> list[tuple[int, ...]]:
    """Vocabulary of a byte-level tokenizer with word ends: bytes, and END where an entry closes a word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, to_byte, out = {x["content"] for x in spec.get("added_tokens", [])}, byte_of_char(), []
    for entry in spec["model"]["vocab"]:
        if entry in special:
            continue
        body, end = (entry[:-4], (END,)) if entry.endswith("</w>") else (entry, ())
        if all(c in to_byte for c in body):
            out.append(tuple(to_byte[c] for c in body) + end)
    return out


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(entries(path))


class WordCounts(dict):
    """Word to piece count; the first words are remembered, up to a bound."""

    def __init__(self, machine: LongestMatch, most: int = 300_000):
        super().__init__()
        self._machine, self._most = machine, most

    def __missing__(self, word: bytes) -> int:
        n = self._machine.count((*word, END))
        if len(self) < self._most:
            self[word] = n
        return n


def counts(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_tokens. ASCII capitals are lowered first, as the vocabulary is."""
    path = vocab or default_vocab()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCounts(automaton(path))
        for b in batches:
            words, tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(utf8(b, "text")):
                split = text.lower().split()
                words[i], tokens[i] = len(split), sum(map(known.__getitem__, split))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.selectExpr(f"cast({id_col} as bigint) doc_id", f"{text_col} as text")
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: words and greedy longest-match tokens of every document."""
    return counts(table(spark, sf_dir, "documents"))
