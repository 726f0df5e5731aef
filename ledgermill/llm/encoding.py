"""Token ids of whole texts by a public tokenizer file, in bounded memory.

A space before a character that is not white space always begins a new pre-token of these files, so the ids of a text
are those of its space-led segments, in order. Segments repeat: their ids are kept between batches, and only new ones
go through the library. A text with white space next to a space goes through it whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tidy

#: Segments kept in a worker's memory, the longest that is kept, and how many new ones are encoded as one text.
MOST_KEPT, LONGEST_KEPT, TOGETHER = 500_000, 40, 256
#: Between new segments; its id marks their ends.
MARK = "\0"
#: In place of a segment's ids: its text must be encoded whole.
WHOLE = b"whole"
#: Signs that are pre-tokens of their own after a letter, and the first character beyond those that plain words have.
TAILS, BEYOND = frozenset(",.;:!?|"), "\u0250"


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def vocabulary_size(path: str) -> int:
    """How many ids a file has, without loading its tokenizer: all that the driver needs."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    return 1 + max([*held["model"]["vocab"].values(), *[t["id"] for t in held.get("added_tokens", [])]])


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class Encoder:
    """Encodes batches of texts to arrays of ids; one for each file and worker process."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.kept: dict[str, bytes] = {}
        marks = self.tokenizer.encode(f"a {MARK} a", add_special_tokens=False).ids
        #: Without a normaliser, tokens spell the bytes of the text, and their lengths show where a segment ends.
        self.lengths = None
        if self.tokenizer.normalizer is None:
            size = self.tokenizer.get_vocab_size()
            self.lengths = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)
            self.lengths[[i for i, t in self.tokenizer.get_added_tokens_decoder().items()]] = 0
        self.mark = marks[1] if len(marks) == 3 else None
        self._plan_plain_words(path)

    def _plan_plain_words(self, path: str) -> None:
        """A word of Latin letters is one pre-token: it needs neither normaliser nor patterns, only the merges."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.signs = byte_signs()
        self.lead = self.signs[32] if self.lengths is not None else ""
        self.plain = Tokenizer(self.tokenizer.model)  # the same merges in memory
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        pieces = [self.plain.id_to_token(i) or "" for i in range(self.plain.get_vocab_size())]
        # which ids begin (with a lead) or end (with a suffix) a word: so the words of a row can be told apart
        self.edge = np.array([p.startswith(self.lead) if self.lead else p.endswith("</w>") for p in pieces], bool)
        self.tails = dict(zip(TAILS, self._ids(list(TAILS)), strict=True))
        probe = ["the", "straße", "Été", "zzxq"]
        self.simple = self._plain_ids([self._spelled(w) for w in probe]) == self._ids([" " + w for w in probe])

    def _spelled(self, word: str) -> str | None:
        """A plain word in the vocabulary's signs; None if it isn't plain."""
        if not word.isalpha() or max(word) >= BEYOND:
            return None
        if not self.lead:
            n, word = len(word), word.lower()
            if len(word) != n:
                return None
        return self.lead + (word if word.isascii() else word.encode().decode("latin-1").translate(self.signs))

    def _plain_ids(self, words: list[str]) -> list[bytes] | None:
        """Ids of each spelled word; None if they can't be told apart."""
        out: list[bytes] = []
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.plain.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.edge[ids])
            at = np.append(at, len(ids)) if self.lead else np.concatenate([[0], at + 1])
            if len(at) != len(part) + 1 or at[0] != 0 or at[-1] != len(ids):
                return None
            raw, at = ids.tobytes(), (at * self.dtype.itemsize).tolist()
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _several(self, segments: list[str]) -> list[bytes]:
        """Ids of each of many segments, encoded as few texts; a text whose parts can't be told goes one by one."""
        out: list[bytes] = []
        parts = [segments[i : i + TOGETHER] for i in range(0, len(segments), TOGETHER)]
        glue = "" if self.lengths is not None else f" {MARK}"
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([glue.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            if self.lengths is not None:
                ends = np.cumsum(self.lengths[ids])
                wanted = np.cumsum([len(s.encode()) for s in part])
                at = np.searchsorted(ends, wanted) + 1
                good = len(ends) and at[-1] == len(ends) and (ends[at - 1] == wanted).all()
            else:
                marks = np.flatnonzero(ids == self.mark)
                good = self.mark is not None and len(marks) == len(part) - 1 and not any(MARK in s for s in part)
                at = np.append(marks, len(ids))
            if not good:
                out += self._ids(part)
                continue
            raw, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for stop in at.tolist():
                out.append(raw[start * width : stop * width])
                start = stop if self.lengths is not None else stop + 1
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and where each text's begin (one more entry: the end). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring(texts, f" {MARK}").to_numpy(zero_copy_only=False)
        # the first segment has no space before it: MARK keeps it apart from the same word after a space
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        at, segments = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = self._lookup(segments)
        whole = [i for i, x in enumerate(found) if x is WHOLE]
        for i in whole:
            found[i] = b""
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool, begin = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(begin[at] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = ends[bounds]
        if whole or odd.any():
            flags = np.zeros(len(found) + 1, bool)
            flags[whole] = True
            marked = np.concatenate([[0], np.cumsum(flags[at])])
            again = np.flatnonzero(odd | (marked[bounds[1:]] > marked[bounds[:-1]]))
            parts = np.split(ids, offsets[1:-1])
            for i, raw in zip(again.tolist(), self._ids(texts.take(pa.array(again)).to_pylist()), strict=True):
                parts[i] = np.frombuffer(raw, self.dtype)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def _lookup(self, segments: list[str]) -> list[bytes]:
        kept = self.kept
        found = list(map(kept.get, segments))
        new = [s for s, x in zip(segments, found) if x is None]
        if not new:
            return found
        own: dict[str, bytes] = {}
        first, rest, words, tailed = [], [], {}, []
        lower, lead = not self.lead, self.lead
        for s in new:
            end = s[-1:]
            word, tail = (s[:-1], end) if end in TAILS else (s, "")
            if not self.simple or not word:
                spelled = None
            elif word.isascii():
                spelled = (word.lower() if lower else lead + word) if word.isalpha() else None
            else:
                spelled = self._spelled(word)
            if spelled is not None:
                tailed.append((s, words.setdefault(spelled, len(words)), tail))
            elif not s or s[0].isspace():
                own[s] = WHOLE
            elif s[0] != MARK:
                rest.append(s)
            elif len(s) > 1:
                first.append(s)
            else:
                own[s] = b""
        ids = self._plain_ids(list(words)) if words else []
        if ids is None:  # they can't be told apart: by the usual way
            rest += [s for s, _, _ in tailed]
        else:
            tails = self.tails
            for s, k, tail in tailed:
                own[s] = ids[k] + tails[tail] if tail else ids[k]
        own.update(zip(first, self._ids([s[1:] for s in first]), strict=True))
        own.update(zip(rest, self._several([" " + s for s in rest]), strict=True))
        if len(kept) + len(own) > MOST_KEPT:
            kept.clear()
        if max(map(len, own)) <= LONGEST_KEPT:
            kept.update(own)
        else:
            kept.update((s, x) for s, x in own.items() if len(s) <= LONGEST_KEPT)
        return [own[s] if x is None else x for s, x in zip(segments, found)]


def portions(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of at most so many bytes each, or of one row; memory goes back between them."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            tidy()
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes)
        tidy()
