"""Words of a column of texts as numbers: Arrow splits and dictionary-encodes, Python sees each distinct word once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import M1, mix64


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words `[^\\x20\\x09-\\x0D]+` in a row, the distinct words, and where each text's words begin (and the end).

    Null counts as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if "" in words:  # before leading and after trailing white space
        real = codes != words.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return codes, words, bounds


class Memo(dict):
    """A function's values for words, kept between batches of a worker (but for very long words) and dropped when there are
    too many."""

    def __init__(self, f: Callable, most: int = 150_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word: str):
        value = self.f(word)
        if len(word) <= 200:
            self[word] = value
        return value

    def of(self, words: list[str]) -> list:
        if len(self) + len(words) > self.most:
            self.clear()
        return [self[w] for w in words]


def hash_word(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased (bytes.lower() knows ASCII alone)."""
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w.encode().lower()) for w in words], dtype=np.uint64) if words else np.zeros(0, np.uint64)


def shingles_of(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words; with fewer words, of the whole sequence; none without words."""
    if not len(h):
        return h
    n = len(h)
    k = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            out = mix64((out + h[i : n - k + 1 + i]) * M1)
    return out
