"""Near-duplicate components by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles; documents with equal sets are one class. Tokens are ordered by
document frequency (rare first), then by hash. If two sets reach the threshold, their prefixes of |x| - ceil(t|x|) + l
tokens share l tokens at least. Each document chooses its own l: a longer prefix costs more list entries, and leaves
fewer candidates because l tokens must be shared; the l with the least estimated cost is taken, and a pair must share
the smaller of its two l. Tokens that no other class has enter no list. Shared tokens are counted over all lists before
a pair is verified on its whole sets. A 128-bit parity bitmap of each set, whose Hamming distance never exceeds the sets'
symmetric difference, drops most hopeless pairs where they arise.

Frequencies are counted over all documents: these are dealt to blocks of bounded size by a hash of doc_id and text, a block asks
key ranges for its tokens with sorted, delta-coded keys, and gets logarithms of frequencies in the order it asked. Keys
are hashes cut to a few bits more than the corpus's tokens need, so a frequency may be too large, never too small.

A list of many documents never emits all its pairs. First each long list is linked to its most central member alone (a
star; lists of over BLOCK members are dealt to salts, with a star each), short lists in full, and components are formed;
a second star links the members of other components to the centres of each list's largest one. Then long lists are compared again, but only
between different components, in blocks of bounded size; a pair leaves once, in the list of the least token that both
have, with the number of tokens that they share. That is exact: every pair that could still join two components is
tested.

Hashes of shingles and sets have 64 bits.

Cases: null text and texts without words have no shingles and are linked with nothing; with fewer words than a shingle
has, the whole sequence is one shingle; rows with the same doc_id are rows of their own, each in the component of its own
set; a null doc_id is never a component's least unless it has no other, and then component_id is null; equal sets are
linked whatever their texts; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, discard, fields, mix64, pieces, release, save, text_bytes, tidy
from .encoding import portions
from .packed import narrow, pack_keys, ranges, rows_table, unpack_keys, wide
from .words import coded_words, shingles_of, word_hashes

#: MB of a block's texts, keys of a range, longest l, members of a list that is compared in full at once, members of a
#: block of a long list, and bits a document and in all of the filter that finds documents again.
BLOCK_MB, RANGE_KEYS, MOST_MATCHES, SHORT, BLOCK, FILTER_BITS, MOST_BITS, SEED = 8.5, 2_000_000, 8, 4, 2048, 16, 1 << 26, 17
#: Centres of a list in its second star.
CENTRES = 3
#: Long lists that a class tells all its lists of; pairs of classes with more leave once in every shared list.
TOLD = 256
#: Steps of a logarithm of two in which frequencies are told.
STEPS = 8
SURVEY = "doc boolean, doc_id long, text_key long, n long, cls long, part int, block int, first long, keys binary, counts binary"
ANSWER = "part int, block int, n long, logs binary"
POSTING = "token long, cls long, n int, need int, bits long, bits2 long"
PAIR = "a long, b long, need int, star boolean"
CROSS = "a long, b long, need int, more int"


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    codes, words, bounds = coded_words(texts)
    h = word_hashes(words)[codes]
    return [np.unique(shingles_of(h[a:b], width)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _class_of(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix64(s * M2)) + np.uint64(len(s)) * M1
        return int(mix64(np.array([total]))[0].astype(np.int64))


def parity_bits(s: np.ndarray) -> tuple[int, int]:
    """128 bits; each tells whether the tokens that fall on it are odd in number."""
    with np.errstate(over="ignore"):
        odd = np.bincount((mix64(s + M1) >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    a, b = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()
    return a, b


class Plan:
    """Sizes that follow from the input's."""

    def __init__(self, docs: DataFrame):
        size = text_bytes(docs)
        self.blocks = pieces(size, BLOCK_MB)
        self.parts = max(1, int(size * 0.15) // RANGE_KEYS)
        self.lists = pieces(size, 14.0, 2)
        self.bits = min(48, max(32, size.bit_length() + 2))

    def keys(self, sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cut hashes of all tokens of a block's classes, each token's place in them, how many, and ranges."""
        every = np.concatenate([np.zeros(0, np.uint64), *sets.values()]) >> np.uint64(64 - self.bits)
        keys, place, counts = np.unique(every, return_inverse=True, return_counts=True)
        return keys, place, counts, ((keys >> np.uint64(self.bits - 24)) * np.uint64(self.parts) >> np.uint64(24)).astype(np.int64)


def _block_sets(table: pa.Table, width: int) -> tuple[list[np.ndarray], list[int]]:
    sets: list[np.ndarray] = []
    for chunk in table["text"].chunks:
        for a, b in portions(chunk):
            sets += shingle_sets(chunk.slice(a, b - a), width)
    return sets, [_class_of(s) for s in sets]


def _survey(width: int, plan: Plan):
    """Each document's class and size, and how many classes of the block have each token."""

    def run(table: pa.Table) -> pa.Table:
        sets, classes = _block_sets(table, width)
        keys, _, counts, part = plan.keys(dict(sorted(zip(classes, sets, strict=True), key=lambda r: r[0])))
        block = table["block"][0].as_py()
        rows = [{"doc": False, "part": int(part[a]), "block": block, "n": b - a, "first": int(keys[a]), "keys": pack_keys(keys[a:b]), "counts": narrow(counts[a:b])} for a, b in ranges(part)]
        tidy()
        docs = pa.table({"doc": pa.array([True] * len(sets)), "doc_id": table["doc_id"], "text_key": table["text_key"], "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array(classes, pa.int64())})
        return pa.concat_tables([rows_table(SURVEY, rows), docs], promote_options="default").select([c.split()[0] for c in SURVEY.split(", ")])

    return run


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    _, place = np.unique(np.concatenate([unpack_keys(r["first"], r["keys"], r["n"]) for r in rows]), return_inverse=True)
    total = np.bincount(place, np.concatenate([wide(r["counts"], r["n"]) for r in rows]))
    logs = np.minimum(np.ceil(STEPS * np.log2(total)), 255).astype(np.uint8)[place]
    ends = np.cumsum([r["n"] for r in rows])
    tidy()
    return rows_table(ANSWER, [{"part": r["part"], "block": r["block"], "n": r["n"], "logs": logs[e - r["n"] : e].tobytes()} for r, e in zip(rows, ends.tolist(), strict=True)])


def choose_matches(others: np.ndarray, n: int, percent: int) -> int:
    """How many tokens a document must share, by estimated cost; others: classes that its tokens meet, in their order.

    The cost is the entries of the lists met, and a verification for each class that is met k times; of those that are
    met at all, about one in k * k are.
    """
    least = -(-percent * n // 100)
    k = np.arange(1, min(MOST_MATCHES, least) + 1)
    listed = np.cumsum(others)[n - least + k - 1]
    return int(k[np.argmin(listed + (1 + n / 16) * listed / k**2)])


def _postings(width: int, percent: int, plan: Plan):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        sets, classes = _block_sets(table, width)
        different = dict(sorted(zip(classes, sets, strict=True), key=lambda r: r[0]))
        keys, place, _, _ = plan.keys(different)
        logs = np.frombuffer(b"".join(r["logs"] for r in sorted(answers.to_pylist(), key=lambda r: r["part"])), np.uint8)
        if len(logs) != len(keys):
            raise ValueError("a block's documents changed between two reads of the input")
        log, start, out = logs[place], 0, []
        for cls, s in different.items():
            n = len(s)
            own = log[start : start + n]
            start += n
            if not n or not own.any():  # nobody shares a token
                continue
            order = np.argsort(own, kind="stable")
            s, own = s[order], own[order]
            df = np.exp2(own / STEPS)
            need = choose_matches(df - 1, n, percent)
            first = n - -(-percent * n // 100) + need
            shared = np.flatnonzero(own[:first])
            if len(shared) >= need:
                out.append((s[shared].view(np.int64), cls, n, need, *parity_bits(s)))
        tidy()
        sizes = [len(x[0]) for x in out]
        spread = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in out], np.int64), sizes).astype(kind))
        tokens = pa.array(np.concatenate([np.zeros(0, np.int64), *[x[0] for x in out]]))
        return pa.table({"token": tokens, "cls": spread(1, np.int64), "n": spread(2, np.int32), "need": spread(3, np.int32), "bits": spread(4, np.int64), "bits2": spread(5, np.int64)})

    return run


def _far(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes or bitmaps rule them out."""
    n, m = g["n"][i].astype(np.int64), g["n"][j].astype(np.int64)
    apart = sum(np.bitwise_count((g[c][i] ^ g[c][j]).view(np.uint64)).astype(np.int64) for c in ("bits", "bits2"))
    return apart > n + m - 2 * needed(n, m, percent)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of a sorted stream, several at a time: arrays of columns, with starts of groups under ''."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
        size = len(held[keys[0]])
        if not size:
            continue
        change = np.zeros(size, bool)
        change[0] = True
        for k in keys:
            change[1:] |= held[k][1:] != held[k][:-1]
        starts = np.flatnonzero(change)
        if len(starts) > 1:
            yield {n: x[: starts[-1]] for n, x in held.items()} | {"": starts}
            held = {n: x[starts[-1] :] for n, x in held.items()}
    if held is not None and len(held[keys[0]]):
        change = np.zeros(len(held[keys[0]]), bool)
        change[0] = True
        for k in keys:
            change[1:] |= held[k][1:] != held[k][:-1]
        yield {n: x for n, x in held.items()} | {"": np.append(np.flatnonzero(change), len(change))}


def _pair_batch(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, star: np.ndarray) -> pa.RecordBatch:
    a, b = g["cls"][i], g["cls"][j]
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.minimum(g["need"][i], g["need"][j])), pa.array(star)], names=["a", "b", "need", "star"])


def _off_centre(g: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How far each row's bitmap is from the bits that most of the rows have."""
    bits = np.stack([g["bits"][rows], g["bits2"][rows]], 1)
    votes = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    middle = np.packbits((2 * votes > len(rows)).astype(np.uint8), bitorder="little").view("<i8")
    return np.bitwise_count((bits ^ middle).view(np.uint64)).astype(np.int64).sum(1)


def _first_pairs(percent: int):
    """All pairs of short lists, and each member of a long list with its most central one, if sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["token", "salt"]):
            starts, sizes = g[""][:-1], np.diff(g[""])
            left, right, stars = [], [], []
            for size in range(2, SHORT + 1):
                at = starts[sizes == size]
                for i in range(size):
                    for j in range(i):
                        left.append(at + i)
                        right.append(at + j)
                        stars.append(np.zeros(len(at), bool))
            for at, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
                hub = at + int(_off_centre(g, np.arange(at, at + size)).argmin())
                others = np.delete(np.arange(at, at + size), hub - at)
                left.append(np.full(size - 1, hub))
                right.append(others)
                stars.append(np.ones(size - 1, bool))
            if left:
                i, j, star = np.concatenate(left), np.concatenate(right), np.concatenate(stars)
                ok = ~_far(g, i, j, percent)
                yield _pair_batch(g, i[ok], j[ok], star[ok])

    return run


def _next_pairs(percent: int):
    """Members of other components with the most central members of a list's largest one, if sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["token", "salt"]):
            for at, end in zip(g[""][:-1].tolist(), g[""][1:].tolist(), strict=True):
                names, counts = np.unique(g["comp"][at:end], return_counts=True)
                if len(names) == 1:
                    continue
                rows = np.arange(at, end)
                inside = g["comp"][at:end] == names[counts.argmax()]
                centres = rows[inside][np.argsort(_off_centre(g, rows)[inside], kind="stable")[:CENTRES]]
                i, j = (x.ravel() for x in np.meshgrid(centres, rows[~inside]))
                ok = ~_far(g, i, j, percent)
                if ok.any():
                    yield _pair_batch(g, i[ok], j[ok], np.ones(int(ok.sum()), bool))

    return run


def _told(lists: list[np.ndarray | None], token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which classes tell their lists; a 0/1 matrix of lists that several of them are in; which columns are less than token."""
    known = np.array([x is not None for x in lists])
    every = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in lists]
    names, place, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    matrix = np.zeros((len(lists), max(1, int((counts > 1).sum()))), np.float32)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in every])
    several = counts[place] > 1
    matrix[row[several], column[place[several]]] = 1
    return known, matrix, np.append(names[counts > 1] < token, np.zeros(matrix.shape[1] - int((counts > 1).sum()), bool))


def _cross_pairs(percent: int):
    """Pairs of different components within a list, block against block, if sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["token", "x", "y"]):
            for at, end in zip(g[""][:-1].tolist(), g[""][1:].tolist(), strict=True):
                if (g["comp"][at:end] == g["comp"][at]).all():
                    continue
                same = g["x"][at] == g["y"][at]
                rows = np.arange(at, end)
                one = rows if same else rows[g["own"][at:end] == g["x"][at]]
                two = rows if same else rows[g["own"][at:end] == g["y"][at]]
                known, matrix, less = _told(list(g["mine"][at:end]), g["token"][at])
                for s in range(0, len(one), 256):
                    i, j = one[s : s + 256][:, None], two[None, :]
                    shared = matrix[i[:, 0] - at] @ matrix[two - at].T
                    before = matrix[i[:, 0] - at][:, less] @ matrix[two - at][:, less].T
                    told = known[i - at] & known[j - at]
                    need = np.minimum(g["need"][i], g["need"][j])
                    # short lists can add at most as many matches as either class has of them
                    enough = shared + np.minimum(g["short"][i], g["short"][j]) >= need
                    ok = (g["comp"][i] != g["comp"][j]) & (~told | ((before == 0) & enough))
                    if same:
                        ok &= i < j
                    ok &= ~_far(g, i, j, percent)
                    p, q = np.nonzero(ok)
                    if len(p):
                        a, b = g["cls"][i[:, 0][p]], g["cls"][two[q]]
                        more = np.where(told[p, q], shared[p, q], 1).astype(np.int32)
                        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need[p, q].astype(np.int32)), pa.array(more)], names=["a", "b", "need", "more"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """cls and shingle set of the classes in ids (doc_id, cls), from rows with their doc_ids; each row's set names its
    class, so rows that share a doc_id, or have none, are told apart. A filter as large as ids needs finds the rows; a
    join on doc_id does where it would be too large to broadcast."""
    n = ids.count()
    size = 1 << max(16, (FILTER_BITS * n).bit_length())
    rows = fields(docs, "doc_id", "text")
    if size > MOST_BITS:
        wanted = ids.select(F.col("doc_id").alias("wanted")).distinct()
        rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
        shared = None
    else:
        probe = lambda c: [F.pmod(F.xxhash64(c, F.lit(SEED + k)), F.lit(size)) for k in (1, 2)]
        marked = ids.select(F.explode(F.array(*probe("doc_id"))).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        filter_ = np.zeros(size // 64, np.int64)  # MOST_BITS / 8 bytes at most
        filter_[marked["word"].to_numpy()] = marked["bits"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(filter_)
        rows = rows.select("doc_id", "text", *[p.alias(f"p{k}") for k, p in enumerate(probe("doc_id"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch
            if shared is not None:
                ok = np.ones(batch.num_rows, bool)
                for k in (2, 3):
                    p = batch.column(k).to_numpy(zero_copy_only=False)
                    ok &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
                found = batch.filter(pa.array(ok))
            for a, b in portions(found.column(1)):
                sets = shingle_sets(found.column(1).slice(a, b - a), width)
                yield pa.record_batch([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "items"])

    return rows.mapInArrow(run, "cls long, items binary").join(ids.select("cls"), "cls")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of classes that reach the threshold; a class's set comes from a document of it."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    ids = save(members.join(classes, "cls").select(F.col("rep").alias("doc_id"), "cls"), "join-members")
    sets = save(_sets_of(docs, ids, width).groupBy("cls").agg(F.first("items").alias("items")), "join-sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    links = save(both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "join-links")
    discard(ids, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its component's least node) of an edge table (a, b), by alternating star steps until stable."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before, old = None, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = save(small, "join-stars")
        if old is not None:
            discard(old)
        old = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = now


def _membership(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key (a hash of the text), n_shingles and cls of every row; cls, its component and component_id."""
    plan = Plan(docs)
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(plan.blocks)).cast("int").alias("block")  # rows of one doc_id, or none, are dealt by their texts
    rows = fields(docs, "doc_id", "text").select(block, "doc_id", F.xxhash64("text").alias("text_key"), "text")
    survey = save(rows.groupBy("block").applyInArrow(_survey(width, plan), SURVEY), "join-survey")
    own = save(survey.filter("doc").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "cls"), "join-documents")
    classes = save(own.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")), "join-classes")
    release(docs.sparkSession)
    answers = save(survey.filter("NOT doc").select("part", "block", "n", "first", "keys", "counts").groupBy("part").applyInArrow(_answer, ANSWER), "join-frequencies")
    discard(survey)
    posted = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_postings(width, percent, plan), POSTING)
    # equal sets of several blocks list a token once; the lists' own lengths decide how many salts each is dealt to
    posted = save(posted.repartition(plan.lists, "token", "cls").dropDuplicates(["token", "cls"]), "join-postings")
    lengths = save(posted.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > SHORT), "join-lengths")
    listed = posted.join(lengths.filter(F.col("df") > BLOCK), "token", "left").withColumn("salt", F.coalesce(F.pmod("cls", F.ceil(F.col("df") / BLOCK)), F.lit(0)).cast("int"))
    release(docs.sparkSession)
    dealt = lambda df, *keys: df.repartition(plan.lists, *keys).sortWithinPartitions(*keys, "n", "cls")
    columns = ["token", "cls", "n", "need", "bits", "bits2"]
    first = save(dealt(listed.select("salt", *columns), "token", "salt").mapInArrow(_first_pairs(percent), PAIR).groupBy("a", "b").agg(F.count("*").alias("met"), F.count_if(~F.col("star")).alias("c"), F.min("need").alias("need")), "join-pairs")
    tried = first.filter("met >= need").select("a", "b")
    links = _links(docs, tried, classes, width, percent)
    comp = save(components(links), "join-components")

    def mixed_lists() -> DataFrame:
        """Members of long lists that still have several components."""
        seen = posted.join(lengths, "token").join(comp, posted["cls"] == comp["node"], "left").select(*columns, F.coalesce("comp", "cls").alias("comp"), F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks"))
        mixed = seen.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        return seen.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    def grown(found: DataFrame) -> DataFrame:
        """Components with the links of these pairs added."""
        more = _links(docs, found, classes, width, percent)
        stars = comp.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        return save(components(stars.unionByName(more)), "join-components")

    second = dealt(mixed_lists().select(*columns, "comp", F.col("own").alias("salt")), "token", "salt").mapInArrow(_next_pairs(percent), PAIR)
    second = second.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).filter("met >= need").select("a", "b")
    second = save(second.join(tried, ["a", "b"], "left_anti"), "join-pairs")
    if not second.isEmpty():
        comp = grown(second)
    tried = tried.unionByName(second)

    met = save(mixed_lists(), "join-mixed")
    mine = met.groupBy("cls").agg(F.sort_array(F.collect_set("token")).alias("mine")).withColumn("mine", F.when(F.size("mine") <= TOLD, F.col("mine")))
    short = posted.join(lengths.select("token"), "token", "left_anti").groupBy("cls").agg(F.count("*").alias("short"))
    met = met.join(mine, "cls").join(short, "cls", "left").withColumn("short", F.coalesce("short", F.lit(0)).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    again = dealt(met.select("token", "x", "y", "own", *columns[1:], "comp", "mine", "short"), "token", "x", "y").mapInArrow(_cross_pairs(percent), CROSS)
    again = again.groupBy("a", "b").agg(F.sum("more").alias("more"), F.min("need").alias("need")).join(first.select("a", "b", "c"), ["a", "b"], "left")
    again = again.filter("more + coalesce(c, 0) >= need").select("a", "b")
    again = save(again.join(tried, ["a", "b"], "left_anti"), "join-pairs")
    if not again.isEmpty():
        comp = grown(again)
    discard(posted)

    nodes = classes.join(comp, classes["cls"] == comp["node"], "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    ids = nodes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return own, nodes.join(ids, "comp").select("cls", "comp", "component_id")


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of every row."""
    own, named = _membership(docs, width, percent)
    linked = own.filter("n_shingles > 0").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that stay: of each component the row of the least doc_id (null comes last,
    then the text's hash decides), and all rows without words. Rows that repeat doc_id and text stay or go together."""
    own, named = _membership(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    rest = own.filter("n_shingles > 0").join(named, "cls")
    first = rest.groupBy("comp").agg(F.min(order).alias("first"))
    gone = rest.join(first, "comp").filter(order != F.col("first")).select("doc_id", "text_key").distinct()
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_key")), "left_anti")
