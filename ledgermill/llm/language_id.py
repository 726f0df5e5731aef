"""Language identification by a linear-chain conditional random field over words.

A word's features are its form, affixes of one to four characters, character 2- and 3-grams, and membership of each
language's lexicon (words that its training windows hold twice or more); transitions between languages are learned.
Training sequences join windows of documents of different languages, so the chain learns where a text switches.
Forward-backward gives each word's posterior over languages; a document's language has the largest mean posterior over
its words with a letter, and that mean is the score. Long documents are cut into blocks whose transfer matrices are
combined, so the result is that of one chain over the whole text.

Learning reads only text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2: WINDOWS windows from each of
about PER_LANGUAGE documents a language, chosen by a hash of the id.

Cases: null text and texts without a letter are `und` with score 0; ties go to the language that sorts first; without
training rows everything is `und`; repeated rows are labelled each; rows without doc_id are neither held
out nor learned from; words of over LONG letters are labelled by all their
features, but not learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, crc_of_id, fields, mix64
from .encoding import portions
from .words import coded_words, hash_word

#: Documents a language and windows of words a document that are learned, hashed features, and the training's settings.
PER_LANGUAGE, WINDOWS, WINDOW, BITS, SEED = 600, 3, 32, 18, 13
LENGTH, BATCH, EPOCHS, RATE, DECAY = 64, 64, 3, 0.15, 1e-6
#: Longer words (of scripts without spaces) are learned from as pieces of so many characters; positions of a block; characters whose features are looked up at once.
LONG, BLOCK, TOGETHER = 40, 64, 320_000
UNKNOWN = "und"


#: What core() strips at once; other signs are stripped one by one.
_SIGNS = "".join(chr(i) for i in range(128) if not chr(i).isalpha())


def core(word: str) -> str:
    """The word in lower case without what stands before its first and after its last letter; '' without a letter."""
    w = word.strip(_SIGNS)
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while a < b and not w[b - 1].isalpha():
        b -= 1
    w = w[a:b]
    return w.lower()


def word_features(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each core (words x features) and which of them are real: form, affixes, 2- and 3-grams."""
    n = len(cores)
    size = np.fromiter(map(len, cores), np.int64, n)
    wide = int(size.max(initial=1))
    c = np.array([f"^{w}$" for w in cores], dtype=f"<U{wide + 2}").view(np.uint32).reshape(n, wide + 2).astype(np.uint64)
    place = np.arange(wide + 2)
    shift = np.uint64(64 - BITS)
    ids, real = [], []
    with np.errstate(over="ignore"):
        two = mix64(c[:, :-1] * M1 + c[:, 1:])
        ids += [two, mix64(two[:, :-1] * M1 + c[:, 2:])]
        real += [place[None, : wide + 1] <= size[:, None], place[None, :wide] < size[:, None]]
        head, tail = np.full(n, np.uint64(1)), np.full(n, np.uint64(2))
        for k in range(1, min(4, wide) + 1):
            head = mix64((head + c[:, k]) * M1)
            tail = mix64((tail + c[np.arange(n), np.maximum(size + 1 - k, 0)]) * M1)
            ids += [head[:, None], tail[:, None]]
            real += [(k <= size)[:, None]] * 2
    ids.append(mix64(np.fromiter(map(hash_word, cores), np.uint64, n))[:, None])
    real.append((size > 0)[:, None])
    return (np.concatenate(ids, axis=1) >> shift).astype(np.int64), np.concatenate(real, axis=1) & (size > 0)[:, None]


class Chain:
    """Feature weights by language, lexicons and transitions."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.lexicon = langs, {}
        self.weight, self.lexical, self.transition = np.zeros((1 << BITS, n), np.float32), np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)

    def learn(self, windows: list[tuple[str, list[str]]]) -> Chain:
        """AdaGrad on the conditional log-likelihood of joined windows."""
        n, at = len(self.langs), {lang: i for i, lang in enumerate(self.langs)}
        if n < 2:
            return self
        windows = [(lang, [w[i : i + LONG] for w in words for i in range(0, len(w), LONG)]) for lang, words in windows]
        counts: list[Counter] = [Counter() for _ in range(n)]
        for lang, words in windows:
            counts[at[lang]].update(core(w) for w in words)
        for i, c in enumerate(counts):
            for w in (w for w, k in c.items() if w and k > 1):
                self.lexicon[w] = self.lexicon.get(w, 0) | 1 << i
        vocabulary: dict[str, int] = {}
        coded = [(at[lang], np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])) for lang, words in windows if words]
        if not coded:
            return self
        table, real = word_features([core(w) for w in vocabulary])
        real = real.astype(np.float32)
        member = np.array([[self.lexicon.get(core(w), 0) >> i & 1 for i in range(n)] for w in vocabulary], np.float32)
        rng = np.random.default_rng(SEED)
        sums = [np.full_like(x, 1e-3) for x in (self.weight, self.lexical, self.transition)]
        for _ in range(EPOCHS):
            words, labels = [], []
            for i in rng.permutation(len(coded)):  # parts of windows follow each other, whatever their languages
                label, w = coded[i]
                cut = int(rng.integers(1, len(w) + 1))
                for part in (w[:cut], w[cut:]) if rng.random() < 0.5 else (w,):
                    words.append(part)
                    labels.append(np.full(len(part), label))
            w, y = np.concatenate(words), np.concatenate(labels)
            rows = len(w) // LENGTH
            if not rows:
                w, y, rows = np.resize(w, LENGTH), np.resize(y, LENGTH), 1
            w, y = w[: rows * LENGTH].reshape(rows, LENGTH), y[: rows * LENGTH].reshape(rows, LENGTH)
            for a in range(0, rows, BATCH):
                self._batch(w[a : a + BATCH], y[a : a + BATCH], table, real, member, sums)
        return self

    def _batch(self, w, y, table, real, member, sums) -> None:
        n, rows = len(self.langs), len(w)
        f, r, m = table[w], real[w], member[w]
        e = (self.weight[f] * r[..., None]).sum(2) + m @ self.lexical
        emit = np.exp(e - e.max(-1, keepdims=True)).astype(np.float64)
        a = np.exp(self.transition.astype(np.float64))
        alpha, beta = np.empty((LENGTH, rows, n)), np.empty((LENGTH, rows, n))
        v = np.full((rows, n), 1.0 / n)
        for t in range(LENGTH):
            v = (v @ a) * emit[:, t]
            v /= v.sum(1, keepdims=True)
            alpha[t] = v
        v = np.ones((rows, n))
        for t in range(LENGTH - 1, -1, -1):
            beta[t] = v
            v = (v * emit[:, t]) @ a.T
            v /= v.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(-1, keepdims=True)
        error = np.eye(n)[y] - post.transpose(1, 0, 2)
        pair = alpha[:-1, :, :, None] * a * (beta * emit.transpose(1, 0, 2))[1:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        seen = np.zeros((n, n))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        flat, kept = f.reshape(-1), np.repeat(error.reshape(-1, n), f.shape[-1], axis=0) * r.reshape(-1, 1)
        used, inverse = np.unique(flat, return_inverse=True)
        g = np.stack([np.bincount(inverse, kept[:, i], len(used)) for i in range(n)], 1) / rows
        for x, s, at, grad in ((self.weight, sums[0], used, g), (self.lexical, sums[1], slice(None), np.einsum("rtk,rtl->kl", m, error) / rows), (self.transition, sums[2], slice(None), (seen - pair.sum((0, 1))) / rows)):
            grad = grad - DECAY * x[at]
            s[at] += grad * grad
            x[at] += (RATE * grad / np.sqrt(s[at])).astype(np.float32)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """exp of the scores of words by language (1 without a letter), and which words have a letter."""
        n = len(self.langs)
        cores = list(map(core, words))
        out = np.zeros((len(words), n), np.float32)
        sizes = np.fromiter(map(len, cores), np.int64, len(cores))
        order = np.argsort(sizes, kind="stable")
        a = 0
        while a < len(words):  # words of like length side by side; a very long one alone
            b = min(len(words), a + 8192)
            while b > a + 1 and (sizes[order[b - 1]] + 2) * (b - a) > TOGETHER:
                b = a + (b - a) // 2
            own = order[a:b]
            a = b
            part = [cores[i] for i in own.tolist()]
            ids, real = word_features(part)
            e = np.zeros((len(part), n), np.float32)
            step = max(1, 65_536 // len(part))  # columns at once: one for many words, many for a very long word
            for k in range(0, ids.shape[1], step):
                e += (self.weight[ids[:, k : k + step]] * real[:, k : k + step, None]).sum(1, dtype=np.float32)
            mask = np.fromiter(map(self.lexicon.get, part, [0] * len(part)), np.int64, len(part))
            out[own] = e + (mask[:, None] >> np.arange(n) & 1).astype(np.float32) @ self.lexical
        return np.exp(out - out.max(1, keepdims=True)), np.fromiter(map(bool, cores), bool, len(cores))

    def posteriors(self, emit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each word, given its emissions (words x languages) and where the documents begin."""
        n = len(self.langs)
        a = np.exp(self.transition)
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total:
            return np.zeros((0, n), np.float32)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        rank = np.arange(total) - first[doc]
        start = bounds[:-1][doc] + rank * BLOCK
        real = np.minimum(BLOCK, bounds[1:][doc] - start)
        order = np.argsort(-real, kind="stable")  # blocks still running at a position are the first ones
        start, real = start[order], real[order]
        active = [int((real > t).sum()) for t in range(BLOCK)]
        move = np.tile(np.eye(n, dtype=np.float32), (total, 1, 1))
        for t in range(BLOCK):
            k = active[t]
            x = (move[:k].reshape(-1, n) @ a).reshape(k, n, n) * emit[start[:k] + t][:, None, :]
            move[:k] = x / x.max((1, 2), keepdims=True)
        moved = np.empty_like(move)
        moved[order] = move
        fore, back = np.empty((total, n), np.float32), np.empty((total, n), np.float32)
        v, u = np.full((len(sizes), n), 1.0 / n, np.float32), np.ones((len(sizes), n), np.float32)
        by = np.argsort(-blocks, kind="stable")
        for r in range(int(blocks.max())):
            d = by[: int((blocks > r).sum())]
            b = first[d] + r
            fore[b] = v[d]
            x = np.einsum("di,dij->dj", v[d], moved[b])
            v[d] = x / x.sum(1, keepdims=True)
            b = first[d] + blocks[d] - 1 - r
            back[b] = u[d]
            x = np.einsum("dij,dj->di", moved[b], u[d])
            u[d] = x / x.sum(1, keepdims=True)
        v, u = fore[order], back[order]
        out = np.empty((len(emit), n), np.float32)
        for t in range(BLOCK):
            k = active[t]
            x = (v[:k] @ a) * emit[start[:k] + t]
            v[:k] = x / x.sum(1, keepdims=True)
            out[start[:k] + t] = v[:k]
        for t in range(BLOCK - 1, -1, -1):
            k = active[t]
            out[start[:k] + t] *= u[:k]
            x = (u[:k] * emit[start[:k] + t]) @ a.T
            u[:k] = x / x.sum(1, keepdims=True)
        return out / out.sum(1, keepdims=True)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows of words at places that depend on the text alone; short texts are one window."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.split()
            rng = np.random.default_rng(zlib.crc32(text.encode()))
            starts = [0] if len(words) <= WINDOW else sorted(rng.integers(0, len(words) - WINDOW + 1, WINDOWS).tolist())
            parts = [" ".join(words[s : s + WINDOW]) for s in starts if words]
            if parts:
                yield pa.record_batch([pa.array([lang] * len(parts)), pa.array(parts)], names=["lang", "words"])


def learn(docs: DataFrame) -> Chain:
    known = fields(docs, "doc_id", "lang", "text").filter((crc_of_id() % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Chain([])
    rate = F.create_map(*[F.lit(x) for lang, c in sorted(counts.items()) for x in (lang, min(1.0, PER_LANGUAGE / c))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < rate[F.col("lang")] * float(1 << 30))
    got = chosen.select("lang", "text").mapInArrow(_windows, "lang string, words string").toArrow()
    windows = sorted(zip(got["lang"].to_pylist(), got["words"].to_pylist(), strict=True))
    return Chain(sorted(counts)).learn([(lang, words.split()) for lang, words in windows])


def identify(docs: DataFrame, chain: Chain, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_words; with_spans adds runs of words of one language as (start, length, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2**BITS weights a language, and the windows' words
    schema = "doc_id long, lang_pred string, score double, n_words long" + ", spans array<struct<start:int,length:int,lang:string>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = len(c.langs)
        for batch in batches:
            for a, b in portions(batch.column(1)):
                part = batch.slice(a, b - a)
                codes, words, bounds = coded_words(part.column(1))
                if n:
                    emit, known = c.emissions(words)
                    post, letters = c.posteriors(emit[codes], bounds), known[codes]
                else:
                    post, letters = np.zeros((len(codes), 0), np.float32), np.zeros(len(codes), bool)
                sums = np.zeros((len(bounds), n))
                sums[1:] = np.cumsum(post * letters[:, None], axis=0, dtype=np.float64)[bounds[1:] - 1] if len(post) else 0
                sums[1:][bounds[1:] == 0] = 0
                own = np.diff(sums, axis=0)
                many = np.diff(np.concatenate([[0], np.cumsum(letters)])[bounds])
                good = (many > 0) & (n > 0)
                best = own.argmax(1) if n else np.zeros(len(many), int)
                share = np.clip(own.max(1) / np.maximum(many, 1), 0, 1) if n else np.zeros(len(many))
                columns = [
                    part.column(0), pa.array([c.langs[i] if g else UNKNOWN for i, g in zip(best.tolist(), good.tolist(), strict=True)], pa.string()),
                    pa.array(np.where(good, share, 0.0)), pa.array(np.diff(bounds), pa.int64()),
                ]
                if with_spans:
                    label = np.where(letters, post.argmax(1), n) if n else np.full(len(codes), n)
                    names = [*c.langs, UNKNOWN]
                    spans = []
                    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        cut = np.flatnonzero(np.diff(label[s:e], prepend=-1))
                        spans.append([{"start": int(i), "length": int(j - i), "lang": names[label[s + i]]} for i, j in zip(cut, [*cut[1:], e - s], strict=True)] if e > s else [])
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))))
                yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score", "n_words", *["spans"] * with_spans])

    return fields(docs, "doc_id", "text").mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    out = identify(docs, learn(docs))
    return out.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")
