import base64
import random
import struct
import zlib
from collections import Counter as Tally
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ldaplens.llm.byte_bpe import Codec, decode, encode, round_trip
from ldaplens.llm.packing import Fillings, Ids, pack_documents
from ldaplens.llm.token_counts import Counter, token_counts
from ldaplens.llm.wordsplit import SAFE

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def random_texts(n=1500):
    rng = random.Random(5)
    letters = [chr(c) for a, b in SAFE for c in range(a, b + 1)] + list("ΣσЖ中日😀́​　ﬁ")
    return ["".join(rng.choices(letters + list("  \n\t'stremvlld") * 30, k=rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def reference_codec():
    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(library):
    count, ids = Counter(WORD).count, Ids(WORD, limit=50)
    for t in random_texts():
        expected = library.encode(t, add_special_tokens=False).ids
        assert count(t) == len(expected), repr(t)
        assert ids.encode(t) == struct.pack(f"<{len(expected)}I", *expected), repr(t)


def test_token_counts_of_odd_rows(spark, odd, library):
    got = token_counts(odd, WORD, limit=100).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    expected = []
    for r in odd.collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        expected.append((r["doc_id"], len(t.encode()), n, n > 100))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert token_counts(odd.limit(0), WORD).count() == 0


def test_byte_codec_equals_the_library(reference_codec):
    c = Codec(BYTE, P.PATTERN)
    for t in [*random_texts(), " " * 700 + "a", "é" * 900, "aaab" * 500]:
        packed = c.encode(t)
        assert memoryview(packed).cast("I").tolist() == reference_codec.encode_ordinary(t), repr(t)
        assert c.decode(memoryview(packed).cast("I")) == t.encode()


def test_round_trip_of_odd_rows(spark, odd, reference_codec):
    got = sorted(map(tuple, round_trip(odd, BYTE, P.PATTERN).collect()), key=str)
    expected = []
    for r in odd.collect():
        t = r["text"] or ""
        ids = reference_codec.encode_ordinary(t)
        expected.append((r["doc_id"], len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(t.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    again = decode(encode(odd, BYTE, P.PATTERN), BYTE, P.PATTERN).collect()
    assert sorted((bytes(r["content"]) for r in again)) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert round_trip(odd.limit(0), BYTE, P.PATTERN).count() == 0


def check_packing(docs, library, capacity, end_id=1):
    got = pack_documents(docs, WORD, capacity, end_id).collect()
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [end_id]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((r["doc_id"], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in got)


def test_packing_of_odd_rows(spark, odd, library):
    for capacity in (7, 100, 4096):
        sequences, tokens = check_packing(odd, library, capacity)
        assert sequences <= -(-tokens // capacity) * 11 // 9 + 1
    assert pack_documents(odd.limit(0), WORD).count() == 0


def test_packing_splits_a_common_length(spark, library, monkeypatch):
    from ldaplens.llm import packing

    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rows = [(i, "same words" if i % 3 else "other " * (i % 17)) for i in range(900)]
    sequences, tokens = check_packing(spark.createDataFrame(rows, "doc_id long, text string"), library, 64)
    assert sequences == -(-tokens // 64)


def test_fillings_use_every_length_once():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        counts = Tally(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        used: Tally = Tally()
        for times, filling in Fillings(dict(counts), capacity):
            assert times > 0 and sum(filling) <= capacity
            for length in filling:
                used[length] += times
        assert used == counts


def test_exact_complements():
    f = Fillings({10: 1, 4: 1, 3: 2, 2: 1, 1: 1}, 10)
    assert f.exact(4, f.left) == (4,)
    assert sum(f.exact(6, f.left)) == 6 and len(f.exact(6, f.left)) == 2
    assert sorted(f.exact(8, f.left)) == [1, 3, 4] or sum(f.exact(8, f.left)) == 8
    assert Fillings({5: 1}, 10).exact(10, Fillings({5: 1}, 10).left) is None
