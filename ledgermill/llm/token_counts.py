"""Greedy word-piece counts by a linear longest-match automaton, without building the pieces.

The vocabulary's pieces that begin a word and those that continue one form two tries in one automaton. Where no longer
match exists, a node's failure link leads to the node of what remains after the greedy pieces are popped off, and the
number of pieces popped on the way is stored with it; so a word is one pass over its characters with integer additions.
A word is a run of letters, digits and marks, however long, or one other character that is not white space; a word that
cannot be split into pieces counts as one unknown token.

A sentencepiece file gives the vocabulary: pieces behind its word-start sign begin words, all others continue them, and
control and byte pieces are left out.

Cases: null and empty texts have no tokens; repeated rows are counted each; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import fields
from .encoding import portions
from .words import Memo, coded_words

START = "▁"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")


class Automaton:
    """Nodes are numbers: 0 begins a word, 1 continues one. None of fail: no greedy split exists from there."""

    def __init__(self, begins: Iterable[str], continues: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, begins), (1, continues)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = self.next[node][c]
                whole[node] = node > 1
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque((root, c, node) for root in (0, 1) for c, node in self.next[root].items())
        while queue:  # breadth first: links lead to nodes of fewer characters
            parent, c, node = queue.popleft()
            if whole[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, n = self.fail[parent], self.popped[parent]
                while at is not None and c not in self.next[at]:
                    at, m = self.fail[at], self.popped[at]
                    n += m
                if at is not None:
                    self.fail[node], self.popped[node] = self.next[at][c], n
            queue.extend((node, d, x) for d, x in self.next[node].items())

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be split."""
        at, n = 0, 0
        for c in word:
            while c not in self.next[at]:
                n += self.popped[at]
                at = self.fail[at]
                if at is None:
                    return -1
            at = self.next[at][c]
        while at != 1:  # pop what the last node still holds
            n += self.popped[at]
            at = self.fail[at]
            if at is None:
                return -1
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin and pieces that continue words, from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    inner = lambda p: START not in p
    return [p[1:] for p in pieces if p[:1] == START and len(p) > 1 and inner(p[1:])], [p for p in pieces if inner(p)]


_MADE: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    """Words, tokens and unknown tokens of what stands between white space; one automaton for each file and worker."""
    if path not in _MADE:
        automaton = Automaton(*vocabulary(path))

        def tally(run: str) -> tuple[int, int, int]:
            words = _WORD.findall(run)
            counts = [automaton.count(w) for w in words]
            return len(words), sum(n if n >= 0 else 1 for n in counts), counts.count(-1)

        _MADE[path] = Memo(tally)
    return _MADE[path]


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(tokenizer)
        for batch in batches:
            for a, b in portions(batch.column(1)):
                part = batch.slice(a, b - a)
                codes, words, bounds = coded_words(part.column(1))
                each = np.array(memo.of(words), np.int64).reshape(-1, 3)[codes]
                sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(each, axis=0)])[bounds]
                own = np.diff(sums, axis=0)
                yield pa.record_batch([part.column(0), *[pa.array(own[:, k]) for k in range(3)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return fields(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
