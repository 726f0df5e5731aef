"""Quality scores by naive Bayes support vectors.

Features are indicators of n-grams: words and pairs of words as written, and one to three word shapes in a row (a shape
keeps the kinds of characters of a word and says whether it repeats the word before). Each feature is scaled by its class
log-count ratio, and a linear hinge-loss model is fitted to the scaled, length-normalised vectors by dual coordinate
descent. Scores are margins passed through a logistic curve that is fitted to rows held back from the descent.

The model learns from at most SAMPLE labelled rows of SAMPLE_MB of text together, chosen by a hash of their ids; every
whole text is scored.

Cases: null and empty texts score as a text without features; null labels and labels without a document are not learned;
repeated rows are scored each; rows without doc_id are neither held out nor
learned from; several labels of one document all count; with one class only, all scores are that
class's share; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, crc_of_id, fields, mix64, release
from .encoding import portions
from .words import Memo, coded_words, hash_word

#: MB of text that are learned at most: the driver holds about twice that in features.
SAMPLE_MB = 40.0
#: Labelled rows that are learned at most, hashed feature space, smoothing of the counts, and the descent's settings.
SAMPLE, BITS, SMOOTH, COST, EPOCHS, SEED = 6000, 20, 1.0, 1.0, 12, 7
#: Score from which a document counts as good.
THRESHOLD = 0.3
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Kinds of characters, runs shortened: 'Thnt,' is 'Aa,', 'THE%%%' is 'AA%'."""
    out = "".join("0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word)
    return _RUN.sub(lambda m: m[1] * 2 if m[1] == "A" else m[1], out)


def _word(word: str) -> tuple[int, int]:
    return hash_word(word), hash_word("\x01" + shape(word))


_MEMO = Memo(_word)


def features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct hashed features of each text, ascending."""
    codes, words, bounds = coded_words(texts)
    table = np.array(_MEMO.of(words), dtype=np.uint64).reshape(-1, 2)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = codes[a:b]
            w, s = table[own, 0], table[own, 1]
            s = s + np.concatenate([[0], own[1:] == own[:-1]]).astype(np.uint64) * M1 if len(own) else s
            pairs, shapes = mix64(w[:-1] * M1 + w[1:]), mix64(s[:-1] * M1 + s[1:])
            threes = mix64(shapes[:-1] * M1 + s[2:])
            every = np.concatenate([w, pairs, s, shapes, threes]) >> np.uint64(64 - BITS)
            out.append(np.unique(every.astype(np.uint32)))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in portions(batch.column(1)):
            part = batch.slice(a, b - a)
            yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in features(part.column(1))], pa.binary())], names=["label", "features"])


class Model:
    """Weights over hashed features; score() is the probability of label 1."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        y = np.where(labels == 1, 1.0, -1.0)
        self.base = float((y > 0).mean()) if len(y) else 0.5
        self.ratio = self.weight = np.zeros(1 << BITS, np.float32)
        self.curve = (0.0, float(np.log((self.base + 1e-3) / (1 - self.base + 1e-3))))
        if len(set(y.tolist())) < 2:
            return
        self.ratio = self._ratios(rows, y)
        order = np.random.default_rng(SEED).permutation(len(y))
        held, seen = order[: len(y) // 4], order[len(y) // 4 :]
        if len(set(y[held].tolist())) == 2 and len(set(y[seen].tolist())) == 2:
            self.ratio = self._ratios([rows[i] for i in seen], y[seen])
            self.weight = self._descend([rows[i] for i in seen], y[seen])
            self.curve = self._logistic(np.array([self.margin(rows[i]) for i in held]), (y[held] > 0).astype(float))
        else:
            self.curve = (4.0, 0.0)
        self.ratio = self._ratios(rows, y)
        self.weight = self._descend(rows, y)

    @staticmethod
    def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """log((p + smooth) / |p|) - log((q + smooth) / |q|) of the indicators' counts in either class."""
        counts = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == side] + [np.zeros(0, np.uint32)]), minlength=1 << BITS) + SMOOTH for side in (1.0, -1.0)]
        return (np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())).astype(np.float32)

    def _scaled(self, row: np.ndarray) -> np.ndarray:
        x = self.ratio[row]
        return x / max(float(np.sqrt(x @ x)), 1e-6)

    def _descend(self, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Dual coordinate descent for the hinge loss; the rarer class costs as much in all as the other."""
        w = np.zeros(1 << BITS, np.float32)
        sizes = np.cumsum([len(r) for r in rows])
        xs = np.split(np.concatenate([self._scaled(r) for r in rows]), sizes[:-1])
        cost = np.where(y > 0, COST, COST * max(1.0, (y > 0).sum() / (y < 0).sum()))
        alpha = np.zeros(len(y))
        rng = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            most = 0.0
            for i in rng.permutation(len(y)):
                row, x = rows[i], xs[i]
                g = y[i] * float(w[row] @ x) - 1.0
                q = float(x @ x) + 1e-9
                new = min(max(alpha[i] - g / q, 0.0), cost[i])
                if new != alpha[i]:
                    w[row] += np.float32((new - alpha[i]) * y[i]) * x
                    most = max(most, abs(new - alpha[i]))
                    alpha[i] = new
            if most < 1e-3:
                break
        return w

    @staticmethod
    def _logistic(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
        """Slope and offset by Newton steps, with smoothed targets and a small penalty on the slope."""
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            ga, gb = ((p - t) * m).sum() + 1e-3 * a, (p - t).sum()
            haa, hab, hbb = (v * m * m).sum() + 1e-3, (v * m).sum(), v.sum() + 1e-9
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-9:
                break
        return float(a), float(b)

    def margin(self, row: np.ndarray) -> float:
        return float(self.weight[row] @ self._scaled(row)) if len(row) else 0.0

    def score(self, row: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(row) + b, -30, 30))))


def fitting(rows: list[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """Of rows (doc_id, label, bytes) in their order, those that fit in the room left by the ones before; others are passed over."""
    out = []
    for doc_id, label, size in rows:
        if size <= room:
            room -= size
            out.append((doc_id, int(label)))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the rows whose crc32(doc_id) mod 5 is not 0; at most SAMPLE of them and SAMPLE_MB of their texts, in
    the order of a hash of the id; a text that doesn't fit any more is passed over, smaller ones after it are not."""
    known = fields(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & (crc_of_id() % 5 != 0))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("quality")]
    chosen = known.distinct().orderBy(*order).limit(SAMPLE)
    texts = fields(docs, "doc_id", "text")
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
    # at most SAMPLE rows of three numbers: which of them fit in SAMPLE_MB together
    picked = fitting([(r["doc_id"], r["quality"], r["bytes"]) for r in sizes.orderBy(*order).collect()], int(SAMPLE_MB * 1e6))
    fit_in = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int")
    rows = texts.join(F.broadcast(fit_in), "doc_id").select(F.col("quality").cast("int").alias("label"), "text")
    got = rows.mapInArrow(_features, "label int, features binary").toArrow()
    # one array for all rows, in an order that doesn't depend on the partitions
    blobs = got["features"].combine_chunks()
    labels_ = got["label"].to_numpy()
    ends = pc.cumulative_sum(pc.binary_length(blobs).cast(pa.int64())).to_numpy() if len(blobs) else np.zeros(0, np.int64)
    every = np.frombuffer(b"".join(x.as_buffer() for x in blobs), np.uint32)
    parts = np.split(every, ends[:-1] // 4) if len(ends) else []
    order = sorted(range(len(parts)), key=lambda i: (zlib.crc32(parts[i].tobytes()), len(parts[i]), labels_[i]))
    model = Model([parts[i] for i in order], labels_[order])
    del got, blobs, every, parts
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three arrays of 2**BITS at most, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in portions(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), pa.array([m.score(x) for x in features(part.column(1))], pa.float64())], names=["doc_id", "score"])

    out = fields(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that are not rejected; rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in portions(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array([m.score(x) >= THRESHOLD for x in features(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
