"""Encoding and decoding against the tokenizers library, and packing against its contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_backtracking_is_exact(library):
    v = bpe.Vocabulary(bpe.default_vocabulary(), limit=20_000)
    random.seed(3)
    parts = ["a", "b", "  ", "\n", "\t", "é", "ß", "'s", "1", "23", "!", " the", " token", " ", "😀", "\x1c", "\x85", "中文", "<|endoftext|>", "\r\n", "'", "ing", "AAAA"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(random.choice("aeinstr") for _ in range(300)) for _ in range(40)] + ["a" * 3000, " " * 500, "ab" * 1500]
    for t in texts:
        ids = np.frombuffer(v.encode(t), "<u4").tolist()
        assert ids == ids_of(library, t), t
        assert v.decode(v.encode(t)).decode() == library.decode(ids, skip_special_tokens=False)


def test_fast_path_gives_the_same_ids():
    v, w = bpe.vocabulary(bpe.default_vocabulary()), packing.fast_vocabulary(bpe.default_vocabulary())
    for t in ["Hello there,  world\n\n x", "a  b   c", " lead", "tail ", "tail  ", "é\u00a0 è", ""]:
        assert v.encode(t) == w.encode(t)


def test_memory_of_pieces_is_bounded_in_bytes():
    import tracemalloc

    v = bpe.Vocabulary(bpe.default_vocabulary(), limit=8 << 20)
    random.seed(11)
    tracemalloc.start()
    for _ in range(400):
        v.encode(" ".join("".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(8)))
    assert tracemalloc.get_traced_memory()[0] < 24 << 20
    tracemalloc.stop()


def test_round_trip_query(docs, hard_texts, library):
    out = {}
    for r in bpe.round_trip(docs(hard_texts)).collect():
        out[r.doc_id] = r
    assert len(out) == len(hard_texts)
    for k, t in enumerate(hard_texts):
        ids = ids_of(library, t)
        assert out[k].n_tokens == len(ids)
        assert out[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(docs([])).count() == 0
    again = bpe.decode_documents(bpe.encode_documents(docs([(None, "null id stays"), (1, None)]))).collect()
    assert {(r.doc_id, r.text) for r in again} == {(None, "null id stays"), (1, "")}


def check_packing(rows, texts, library):
    by = {}
    bins = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert by.keys() == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = np.array(ids_of(library, t) + [2], "<u4")
        at = 0
        for n, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            assert r.piece == n and r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or n == 0
            at += r.length
        assert at == len(ids)
    return len(bins)


def test_packing(docs, hard_texts, library):
    check_packing(packing.pack_documents(docs(hard_texts)).collect(), hard_texts, library)
    assert packing.pack_documents(docs([])).count() == 0


def test_packing_merges_across_partitions_and_hands_on_few(docs, library):
    random.seed(5)
    texts = [" a" * random.choice([100, 300, 400, 600, 700, 1023]) for _ in range(300)]
    table = docs(texts).repartition(13, "doc_id")
    for options in ({}, {"hand_on": 2, "fan_in": 3, "window": 20}):
        n = check_packing(packing.pack_documents(table, **options).collect(), texts, library)
    whole = check_packing(packing.pack_documents(docs(texts).coalesce(1)).collect(), texts, library)
    assert whole <= n
    assert packing.pack_documents(docs([(None, "x")])).collect()[0].doc_id is None


def test_best_fit():
    assert packing.best_fit([5, 5, 4, 6], 10) == [(1, 0), (1, 5), (0, 6), (0, 0)]
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
