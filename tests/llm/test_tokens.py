import zlib

import numpy as np
import pyarrow as pa
import pytest
from ledgermill.llm import packing, token_counts, token_file
from ledgermill.llm.encoding import Encoder, portions

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", None, "  a", "a  b ", " \n x", "a\n b\t c", "It's <|endoftext|> it", "ΑΣ Σ", "e ́x", "a\r\n b", "\0x", " \0x x", "12 3.4", "a.\n\nb", "é" * 300]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, texts):
    coder = Encoder.of(public_tokenizers.path(name))
    every = ODD + [t for _, t, *_ in texts]
    ids, at = coder.encode(pa.array(every))
    whole = coder.tokenizer.encode_batch([t or "" for t in every], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in whole]
    assert list(portions(pa.array(every), 100))[-1][1] == len(every) and not list(portions(pa.array([], pa.string())))


@pytest.mark.parametrize("n", [1, 31, 32, 1000, 65_536, 200_001])
def test_file_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 500).astype("<u4")
    freq = token_file.frequencies(ids, 501)
    assert freq.sum() == 1 << token_file.SCALE and (freq[np.unique(ids)] > 0).all()
    offsets, states, crcs, words = token_file.encode_ids(ids, freq)
    assert (token_file.decode_blocks(freq, offsets, states, words, n) == ids).all()
    last = len(states) - 1  # a block decodes from its checkpoint alone
    size = token_file.BLOCK if n >= token_file.BLOCK else n
    assert (token_file.decode_blocks(freq, offsets, states, words, n, last, last + 1) == ids[last * size :]).all()


def test_file_of_documents(docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    file = token_file.write(docs, path, 2, shard_ids=5_000, range_mb=0.1)
    assert file.select("part").distinct().count() > 1 and file.filter("shard > 0").count() > 1
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file.read(file).collect())
    coder, at, expected = Encoder.of(path).tokenizer, 0, []
    for i, t in sorted((i, t or "") for i, t, *_ in texts):
        ids = [*coder.encode(t, add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    assert token_file.read(token_file.write(empty, path, 2)).count() == 0
    row = file.first().asDict()
    row["crcs"] = bytes(len(row["crcs"]))
    with pytest.raises(ValueError, match="checksum"):
        token_file.decode_shard(row)


def test_tokens_without_ids(nameless):
    rows, docs = nameless
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Encoder.of(path).tokenizer
    wanted = sorted((str(i), tuple([*coder.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, *_ in rows)
    got = token_file.read(token_file.write(docs, path, 2, shard_ids=300), with_ids=True).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == wanted
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert sorted(str(r["doc_id"]) for r in pieces if r["start"] == 0) == sorted(str(i) for i, *_ in rows)
    counts = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(str(r["doc_id"]) for r in counts) == sorted(str(i) for i, *_ in rows)


def test_packing(docs, texts, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path, 1, capacity=64, with_ids=True).collect()
    coder = Encoder.of(path).tokenizer
    wanted = sorted((i, tuple([*coder.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in texts)
    load, parts = {}, {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == load.get(r["sequence_id"], 0) and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        load[r["sequence_id"]] = r["offset"] + r["length"]
        parts.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert max(load.values()) <= 64
    short = [s >> 32 for s, n in load.items() if n < 64]
    assert len(short) == len(set(short))  # at most one sequence of a group is not full
    one = {i: t for i, t in wanted if i != 5}
    assert {i: tuple(x for _, p in sorted(parts[i]) for x in p) for i in one} == one
    assert packing.pack(empty, path, 1).count() == 0


def test_first_fit_decreasing_like_a_scan():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 21, rng.integers(1, 60)).tolist()
        bins: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            at = next((b for b in bins if sum(sizes[k] for k in b) + sizes[i] <= 20), None)
            if at is None:
                bins.append(at := [])
            at.append(i)
        assert packing.first_fit_decreasing(sizes, 20) == bins


def test_token_counts_like_the_greedy_scan(docs, texts, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    begins, continues = (set(x) for x in token_counts.vocabulary(path))
    most = max(map(len, begins | continues))

    def count(w):
        at, n = 0, 0
        while at < len(w):
            end = next((e for e in range(min(len(w), at + most), at, -1) if w[at:e] in (continues if at else begins)), None)
            if end is None:
                return 1, 1
            at, n = end, n + 1
        return n, 0

    got = sorted((r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts.count_tokens(docs, path).collect())
    memo = {}
    expected = []
    for i, t, *_ in texts:
        each = [memo.setdefault(w, count(w)) for w in token_counts._WORD.findall(t or "")]
        expected.append((i, len(each), sum(n for n, _ in each), sum(u for _, u in each)))
    assert got == sorted(expected)
    assert token_counts.count_tokens(empty, path).count() == 0
