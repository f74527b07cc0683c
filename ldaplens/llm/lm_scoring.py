"""Operator 11: score texts by online logistic context mixing over counts of all training texts.

Training rows are those whose ``crc32(id as text) mod 7`` is not 2. The model (``context_mixing``) needs,
for every context of a text, what followed it in all training texts; base scores need the count of every
word. Neither fits a task, so both stay tables and each part of the input pulls only what it meets:

1. One pass cuts the rows of every task into parts of about ``PART`` bytes and writes three tables: the
   texts in compressed blocks, the counts of each part's (context, byte) pairs, those of its words.
   What is written grows with the input; contexts that only rows held out have count nothing.
2. Pair and word counts are summed over all parts (partial sums first, so a frequent key costs a row a
   task), then joined back to the parts that met the context or word. A context has at most 256 bytes.
3. Blocks and pulled counts of a part meet in a cogroup, which scores its texts.

A part holds whole texts, so its size is bounded by ``PART`` and the longest text; equal texts lie in
whatever part they were read in, so copies never gather in one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common
from ldaplens.llm import context_mixing as cm
from ldaplens.llm.jaccard_join import word_hashes

PART = 32_000_000
BLOCK, PAIR, WORD = 0, 1, 2
TABLES = ("part long, block int, ids array<long>, held array<boolean>, sizes array<long>, last array<boolean>, data binary, "
          "key long, n long, lead boolean, word binary, kind int")
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "bits_per_byte double")

_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(),
          "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in schema.split(", "))])


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def segments(raw: bytes, size: int = 1 << 20):
    """A text in segments of about ``size`` bytes that end where a word does."""
    start = 0
    while len(raw) - start > size:
        gap = _GAP.search(raw, start + size)
        if gap is None:
            break
        yield raw[start:gap.start()]
        start = gap.end()
    yield raw[start:] if start else raw


def words_of(texts: list[bytes]):
    """The words of some texts, a few megabytes at a time: an Arrow array of distinct words, the number
    of each word's entry in it, and the number of its text."""
    some, of, size = [], [], 0
    for i, t in enumerate(texts):
        for seg in segments(t):
            some.append(seg)
            of.append(i)
            size += len(seg)
            if size > 1 << 20:
                yield _words(some, of)
                some, of, size = [], [], 0
    yield _words(some, of)


def _words(some: list[bytes], of: list[int]):
    b = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.cumsum([len(x) + 1 for x in some])
    inside = np.cumsum(~gap, dtype=np.int32)
    offsets = np.append(inside[first] - 1, inside[-1]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(b[~gap])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.array(of, np.int64)[np.searchsorted(ends, first, "right")]


def _cut(rows):
    """Chunks of pieces ``(id, held, piece, last, whole text with its first piece)``; a text too long for
    one goes on in the next."""
    chunk, size = [], 0
    for key, held, raw in rows:
        for at in range(0, len(raw) + 1, cm.PIECE):
            piece, last = raw[at:at + cm.PIECE], at + cm.PIECE > len(raw)
            if size + len(piece) + cm.PAD + 1 > cm.CHUNK or len(chunk) == cm.DOCS:
                yield chunk
                chunk, size = [], 0
            chunk.append((key, held, piece, last, None if at else raw))
            size += len(piece) + cm.PAD + 1
    if chunk:
        yield chunk


def _summed(found: list):
    """Sorted distinct windows and their counts, summed."""
    windows, back = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
    return windows, np.bincount(back, weights=np.concatenate([n for _, n in found]), minlength=len(windows))


def _summed_words(found: list):
    """Distinct words and their counts, summed."""
    coded = pa.chunked_array([w for w, _ in found], pa.binary()).combine_chunks().dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices, weights=np.concatenate([n for _, n in found]), minlength=len(coded.dictionary))


class _Part:
    """Blocks, pair counts and word counts of one part, as Arrow batches of ``TABLES``."""

    def __init__(self, number: int):
        self.number, self.blocks, self.bytes = number, 0, 0
        self.windows: list = []
        self.words: list = []

    def _batch(self, kind: int, rows: int, **columns) -> pa.RecordBatch:
        schema = _arrow(TABLES)
        columns |= {"part": np.full(rows, self.number), "kind": np.full(rows, kind, np.int32)}
        return pa.RecordBatch.from_arrays(
            [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns
             else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def add(self, chunk: list) -> pa.RecordBatch:
        from zstandard import ZstdCompressor

        ids, held, pieces, last, whole = map(list, zip(*chunk))
        for words, at, of in words_of([t or b"" for t in whole]):
            self.words.append((words, np.bincount(at, weights=~np.array(held, bool)[of], minlength=len(words))))
        if len(self.words) >= 8:
            self.words = [_summed_words(self.words)]
        coded = cm.Chunk(pieces, last)
        self.windows.append(coded.distinct(np.repeat(~np.array(held, bool), coded.sizes)))
        if len(self.windows) == 8:
            self.windows = [_summed(self.windows)]
        raw = b"".join(pieces)
        self.blocks, self.bytes = self.blocks + 1, self.bytes + len(raw)
        return self._batch(BLOCK, 1, block=[self.blocks], ids=[ids], held=[held], sizes=[[len(p) for p in pieces]], last=[last],
                           data=[ZstdCompressor(level=1).compress(raw)])

    def counts(self):
        windows, n = _summed(self.windows)
        for k in range(len(cm.CONTEXTS)):
            keys, back = np.unique(cm.contexts(windows, k), return_inverse=True)
            lead = np.ones(len(keys), bool)
            lead[1:] = keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)
            total = np.bincount(back, weights=n, minlength=len(keys)).astype(np.int64)
            for i in range(0, len(keys), 1 << 16):
                t = slice(i, i + (1 << 16))
                yield self._batch(PAIR, len(keys[t]), key=keys[t].astype(np.int64), n=total[t], lead=lead[t])
        words, n = _summed_words(self.words)
        for i in range(0, len(n), 1 << 16):
            yield self._batch(WORD, len(n[i:i + (1 << 16)]), word=words[i:i + (1 << 16)], n=n[i:i + (1 << 16)].astype(np.int64))


def _gather(batches):
    """One task of step 1."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    parts = [_Part(first)]

    def rows():
        for b in batches:
            for key, held, raw in zip(*(c.to_pylist() for c in b.columns)):
                yield key, held, raw.lower()

    for chunk in _cut(rows()):
        part = parts[-1]
        yield part.add(chunk)
        if part.bytes >= PART and chunk[-1][3]:
            yield from part.counts()
            parts[-1] = _Part(part.number + 1)
    if parts[-1].blocks:
        yield from parts[-1].counts()


def _score(train_tokens: int, distinct: int, end_count: int):
    """The cogroup function: scores of a part's texts."""
    def score(blocks: pa.Table, pulled: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        predictors, known = _pulled(pulled)
        end = np.log10(end_count + 1.0)
        floor = np.log10(train_tokens + distinct + 1.0)
        out, open_text = [], None  # a text that goes on: raw pieces, score so far, kept state
        for row in blocks.sort_by("block").to_pylist():
            raw = ZstdDecompressor().decompress(row["data"])
            stops = np.cumsum(row["sizes"])
            pieces = [raw[e - n:e] for e, n in zip(stops, row["sizes"])]
            del raw
            state = cm.State(len(pieces))
            if open_text:
                state.put(open_text[2])
            logp = cm.score(cm.Chunk(pieces, row["last"]), predictors, state)
            if open_text:
                pieces[0] = open_text[0] + pieces[0]
                logp[0] += open_text[1]
            open_text = None
            if not row["last"][-1]:
                open_text = pieces.pop(), logp[-1], state.take(len(pieces))
            sums = np.zeros((3, len(pieces)))  # words, known words, logarithms
            for words, at, of in words_of(pieces):
                log = known.logs_of(words)[at]
                for i, weights in enumerate((None, log > 0, log)):
                    sums[i] += np.bincount(of, weights, len(pieces))
            total = logp[:len(pieces)]
            sizes = np.array([len(p) + 1 for p in pieces])
            out.append([pa.array(row["ids"][:len(pieces)], pa.int64()), pa.array(row["held"][:len(pieces)]), *map(pa.array, (
                (sums[0] + 1).astype(np.int64), (sums[1] + (end_count > 0)).astype(np.int64), np.full(len(pieces), train_tokens),
                sums[2] + end - (sums[0] + 1) * floor, total / np.log(10), -total / np.log(2) / sizes))])
        schema = _arrow(SCHEMA)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(c, schema=schema) for c in out], schema)
    return score


class Known:
    """``log10(count + 1)`` of a part's words, found by their hashes and held against the words themselves, so
    the words are hashed once a part."""

    def __init__(self, words: pa.BinaryArray, n: np.ndarray):
        hashes = self._hashes(words)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], words.take(pa.array(order))
        self.logs = np.append(np.log10(n[order].astype(np.float64) + 1), 0.0)
        self.shared = bool((self.hashes[1:] == self.hashes[:-1]).any())  # two words with one hash: never seen

    @staticmethod
    def _hashes(words: pa.BinaryArray) -> np.ndarray:
        return word_hashes(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"\n")[0].as_py())[0]

    def logs_of(self, words: pa.BinaryArray) -> np.ndarray:
        """The logarithm of each of some words, 0 for an unknown one."""
        none = len(self.words)
        if self.shared or not none:
            return self.logs[pc.index_in(words, self.words).fill_null(none).to_numpy()]
        at = np.minimum(np.searchsorted(self.hashes, self._hashes(words)), none - 1)
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return self.logs[np.where(same, at, none)]


def _pulled(pulled: pa.Table):
    """Predictors and known words from a part's pulled rows."""
    is_word = pulled["ctx"].is_null()
    c, w = pulled.filter(pc.invert(is_word)), pulled.filter(is_word)
    following = c["following"].combine_chunks()
    flat = following.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.repeat(c["ctx"].to_numpy().astype(np.int64), following.value_lengths().to_numpy(zero_copy_only=False)).astype(np.uint64)
    keys = keys << np.uint64(8) | (flat & 255).astype(np.uint64)
    order = np.argsort(keys)
    return cm.Predictors(keys[order], (flat >> 8)[order]), Known(w["word"].combine_chunks(), w["n"].to_numpy())


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    A null text is empty: one token, the end. A null id stays null and counts as the empty text for
    the split (a training row). Repeated rows are rows: each counts, each comes back. An empty table
    gives no rows. Other columns are ignored, whatever their names. A text of any length is read
    whole, 1 MB at a time; where it is cut, contexts start anew and weights go on. Without training rows
    every count is 0.
    """
    spark = docs.sparkSession
    common.python_ready(spark)
    rows = common.texts(docs, id_col, text_col).select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2).alias("held"),
        F.col("text").cast("binary").alias("raw"))
    table = common.written(rows.mapInArrow(_gather, TABLES), "lm-parts")
    blocks, pairs, words = (table.where(F.col("kind") == k) for k in (BLOCK, PAIR, WORD))

    ctx = F.shiftrightunsigned("key", 8)
    following = (pairs.where("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
                 .groupBy(ctx.alias("ctx")).agg(F.collect_list(F.shiftleft("n", 8).bitwiseOR(F.col("key").bitwiseAND(255))).alias("following")))
    seen = common.written(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    pulled = (pairs.where("lead").select(F.col("part").alias("of"), ctx.alias("ctx")).join(following, "ctx")
              .select("of", "ctx", "following", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("n"))
              .unionByName(words.select(F.col("part").alias("of"), "word").join(seen, "word")
                           .select("of", F.lit(None).cast("long").alias("ctx"), F.lit(None).cast("array<long>").alias("following"), "word", "n")))
    parts = blocks.agg(F.countDistinct("part"), F.coalesce(F.sum(F.size(F.filter(F.arrays_zip("held", "last"), lambda x: ~x["held"] & x["last"]))), F.lit(0))).first()
    totals = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    ends = int(parts[1])
    n = max(2 * parts[0], spark.sparkContext.defaultParallelism)
    fn = _score(int(totals[0]) + ends, totals[1] + (ends > 0), ends)
    return (blocks.select("part", "block", "ids", "held", "sizes", "last", "data").repartition(n, "part").groupBy("part")
            .cogroup(pulled.repartition(n, "of").groupBy("of")).applyInArrow(lambda left, right: fn(left, right), SCHEMA))
