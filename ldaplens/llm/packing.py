"""Operator 10: best-fit packing of tokenised documents by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` numbers) is planned on the driver. The plan
is a list of fillings (which lengths share a sequence, and how often); pieces find their places by
their rank among the pieces of equal length, so no sequence or document ever passes the driver.
"""

from __future__ import annotations

import zlib
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ldaplens.llm import common
from ldaplens.llm.wordsplit import lower_words, normal_form, unsafe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Pieces of equal length are ranked in buckets of about this many rows.
BUCKET_ROWS = 5000


class Ids:
    """Token ids of whole texts from a tokenizer file, the ids of common words kept in a memo."""

    def __init__(self, vocab_file: str, limit: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab_file)
        self.word: dict[str, bytes] = {}
        self.limit = limit

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Ids as consecutive 32-bit integers. Words of plain texts are looked up and those not yet
        known go to the library together; texts with special strings or rare characters go there whole."""
        if "<|" in text or unsafe()(text) is not None:
            return self._library([text])[0]
        words = lower_words()(normal_form(text))
        ids = list(map(self.word.get, words))
        if None in ids:
            new = list({w for w, x in zip(words, ids) if x is None})
            if len(self.word) + len(new) > self.limit:
                self.word, new = {}, list({*words})
            self.word.update(zip(new, self._library(new)))
            ids = map(self.word.__getitem__, words)
        return b"".join(ids)


@cache
def ids_of(vocab_file: str) -> Ids:
    return Ids(vocab_file)


def pieces(docs: DataFrame, vocab_file: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only
    where longer than ``capacity``. A null or empty text is the one id ``end_id``."""
    common.python_ready(docs.sparkSession)

    def run(batches):
        from ldaplens.llm.packing import ids_of

        encode = ids_of(vocab_file).encode
        end, step = array("I", [end_id]).tobytes(), 4 * capacity
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, PIECES)


class Fillings:
    """Fillings of sequences for a histogram of lengths.

    The largest length left opens a sequence. Its gap is looked up among single lengths, sums of
    pairs and sums of triples; a combination that fills it exactly is used as often as its
    lengths last. With no exact filling, the best (largest) fitting length goes in and the rest of
    the gap is looked up again.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        import numpy as np

        self.np, self.capacity = np, capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} is outside 1..{capacity}")
            self.left[length] += n
        self.live = self.left > 0

    def _pair(self, total: int, left, floor: int = 1):
        """Available lengths ``a >= b >= floor`` with ``a + b == total``, the largest ``a`` first."""
        np = self.np
        a = np.arange(min(total - floor, self.capacity), (total - 1) // 2, -1)
        if not len(a):
            return None
        need = np.where(2 * a == total, 2, 1)
        hit = np.flatnonzero((left[a] >= need) & (left[total - a] >= 1))
        return (int(a[hit[0]]), int(total - a[hit[0]])) if len(hit) else None

    def exact(self, gap: int, left) -> tuple[int, ...] | None:
        np = self.np
        if left[gap] > 0:
            return (gap,)
        if pair := self._pair(gap, left):
            return pair
        if gap < 3:
            return None
        # triples: for the largest length a, the pair-sum index of the others is asked
        have = np.flatnonzero(left[: gap - 1] > 0)[::-1]
        have = have[have >= 1]
        for a in have.tolist():
            if 3 * a < gap:
                break  # a is the largest of the three
            left[a] -= 1
            pair = self._pair(gap - a, left)
            left[a] += 1
            if pair:
                return (a, *pair)
        return None

    def __iter__(self):
        """``(times, lengths)`` until every length is used up."""
        np, left = self.np, self.left
        while len(have := np.flatnonzero(left)):
            filling = [int(have[-1])]
            left[filling[0]] -= 1
            gap = self.capacity - filling[0]
            while gap:
                if more := self.exact(gap, left):
                    gap = 0
                else:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    more = (int(fits[-1]),)
                    gap -= more[0]
                for length in more:
                    left[length] -= 1
                filling += more
            uses = {length: filling.count(length) for length in filling}
            times = 1 + min(int(left[length]) // n for length, n in uses.items())
            for length, n in uses.items():
                left[length] -= n * (times - 1)
            yield times, filling


def runs(counts: dict[int, int], capacity: int) -> dict[int, tuple[list, ...]]:
    """Per length, runs of ranks: ``(first rank, pieces of it in a sequence, first sequence,
    offsets of those pieces)``. The first sequence of a filling numbers on from the one before."""
    used: dict[int, int] = {}
    out: dict[int, tuple[list, ...]] = {}
    sequence = 0
    for times, filling in Fillings(counts, capacity):
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in filling:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            first = used.get(length, 0)
            for column, v in zip(out.setdefault(length, ([], [], [], [])), (first, len(places), sequence, places)):
                column.append(v)
            used[length] = first + times * len(places)
        sequence += times
    return out


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``' rows.

    The histogram of lengths, at most ``capacity`` rows, is all that reaches the driver; the plan
    sent back is of the same order. Ranks are counted in buckets of about ``BUCKET_ROWS`` rows, so a
    length that holds a third of all pieces is spread over many tasks. Ties (equal ids and pieces,
    from repeated rows) get different ranks, in any order.
    """
    spark = found.sparkSession
    common.python_ready(spark)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = spark.sparkContext.broadcast(runs(counts, capacity))
    most = max(counts.values(), default=0)
    buckets = max(1, -(-most // BUCKET_ROWS))
    spread = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = common.written(spread.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-sizes")
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = (
        spread.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def place(batches):
        import numpy as np

        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                first, each, numbers, places = plan.value[int(one)]
                rows = np.flatnonzero(length == one)
                run = np.searchsorted(first, rank[rows], side="right") - 1
                k = rank[rows] - np.asarray(first)[run]
                each = np.asarray(each)[run]
                sequence[rows] = np.asarray(numbers)[run] + k // each
                offset[rows] = [places[r][x] for r, x in zip(run.tolist(), (k % each).tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_file: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null or empty text: one piece of length 1. Repeated rows are packed each for itself; a null id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    found = common.written(pieces(docs, vocab_file, capacity, end_id, id_col, text_col), "pieces")
    return pack(found, capacity)
