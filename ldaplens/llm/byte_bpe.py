"""Operator 5: byte-level BPE encoding and decoding with a segment tree of pair ranks."""

from __future__ import annotations

import base64
from array import array
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from ldaplens.llm import common
from ldaplens.llm.wordsplit import Bounded, byte_pieces, unsafe

NONE = 1 << 60  # rank of positions that start no mergeable pair


class Codec:
    """Encodes and decodes by a file of ``base64 rank`` lines, each match of ``pattern`` separately."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.packed = Bounded(lambda piece: array("I", self.merge(piece.encode())).tobytes())

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. Leaf i of the tree holds the rank of the pair that starts at byte
        i; inner nodes hold the minimum, and going left on ties finds the leftmost. A merge changes
        three leaves (the pair's own, its right half, the left neighbour's), each in log n steps."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        half = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * half)
        for i in range(n - 1):
            tree[half + i] = ranks.get(piece[i : i + 2], NONE)
        for i in range(half - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # live neighbours; n: none

        def put(i: int, rank: int) -> None:
            i += half
            tree[i] = rank
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while (low := tree[1]) < NONE:
            i = 1
            while i < half:
                i = 2 * i if tree[2 * i] == low else 2 * i + 1
            i -= half
            j = after[i]
            k = after[i] = after[j]
            put(j, NONE)
            if k < n:
                before[k] = i
                put(i, ranks.get(piece[i : after[k]], NONE))
            else:
                put(i, NONE)
            if (h := before[i]) >= 0:
                put(h, ranks.get(piece[h:k], NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as consecutive native 32-bit integers (little-endian on every supported platform)."""
        pieces = byte_pieces()(text) if unsafe()(text) is None else self.split(text)
        return b"".join(map(self.packed.__getitem__, pieces))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every row. Null or empty text: an empty array. Null ids,
    repeated rows and empty tables pass through; other columns are ignored."""
    common.python_ready(docs.sparkSession)

    def run(batches):
        import numpy as np

        from ldaplens.llm.byte_bpe import codec

        one = codec(rank_file, pattern).encode
        for b in batches:
            ids = [np.frombuffer(one(t), "<i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, content`` (the bytes) of ``encode``'s rows. A null or empty array: no bytes."""
    common.python_ready(encoded.sparkSession)

    def run(batches):
        from ldaplens.llm.byte_bpe import codec

        one = codec(rank_file, pattern).decode
        for b in batches:
            content = [one(ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one narrow pass and return the digests of both:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Edge cases as in ``encode``."""
    common.python_ready(docs.sparkSession)

    def run(batches):
        from ldaplens.llm.byte_bpe import codec

        c = codec(rank_file, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                packed = c.encode(t)
                n.append(len(packed) // 4)
                ids_sha.append(sha256(packed).hexdigest())
                text_sha.append(sha256(c.decode(memoryview(packed).cast("I"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
