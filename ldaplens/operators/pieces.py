"""Substring join by a piece filter.

Every needle is looked up by one of its pieces of ``GRAM`` bytes. A bitmap of all pieces, a few bits
each and never over ``MOST_BITS``, goes to every task; a line's windows are hashed where they lie in the
Arrow buffer and tried on it, so a line costs time linear in its length and becomes rows only where a
piece hits. The rows carry the line's key and the piece, no text; they meet the needles by an equi-join,
and what is left joins the lines again, where ``contains`` decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.operators.joins import sized
from ldaplens.session import ship_package

GRAM = 8  # bytes of a piece; a shorter needle is its own piece
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26
BITS_EACH = 32
_STEP = 1 << 20  # windows hashed at once
_BITMAP = 32_768  # bits of one row of the bitmap functions
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def _bit(piece: np.ndarray, size: int, factor: int, bits: int) -> np.ndarray:
    """Bit of each piece under one hash; ``bits`` is a power of two."""
    h = (piece ^ np.uint64(size * 0x9E3779B1)) * np.uint64(factor)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(_FACTORS[0])) >> np.uint64(64 - bits.bit_length() + 1)


def _windows(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The eight bytes from each place in ``[start, stop)``, low byte first; ``data`` is padded by eight."""
    return np.ndarray(stop - start, "<u8", data, start, (1,))


def _needle_pieces(batches):
    """All pieces of each needle: ``file, _needle, size, piece``."""
    for b in batches:
        files, needles, sizes, pieces = [], [], [], []
        for file, needle in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = needle.encode()
            size = min(len(raw), GRAM)
            data = np.frombuffer(raw + bytes(8), np.uint8)
            found = np.unique(_windows(data, 0, len(raw) - size + 1) & _mask(size))
            pieces.append(found)
            files += [file] * len(found)
            needles += [needle] * len(found)
            sizes += [size] * len(found)
        piece = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(needles, pa.string()), pa.array(sizes, pa.int32()),
                                          pa.array(piece.view(np.int64))], names=["file", "_needle", "size", "piece"])


def _bits(bits: int):
    """``size, piece`` to the numbers of their bits."""
    def numbers(batches):
        for b in batches:
            piece, size = b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy().astype(np.uint64)
            out = [np.zeros(0, np.int64)]
            for n in np.unique(size):
                out += [_bit(piece[size == n], int(n), f, bits).astype(np.int64) for f in _FACTORS]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["bit"])
    return numbers


def piece_bitmap(picked: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of ``size, piece`` as bytes: rows of 4 KB, ``bits`` at most, come to the driver."""
    bit = picked.select("size", "piece").distinct().mapInArrow(_bits(bits), "bit bigint")
    rows = bit.groupBy(F.floor(F.col("bit") / _BITMAP).alias("row")).agg(
        F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("map")).collect()
    out = np.zeros(max(bits, _BITMAP) // 8, np.uint8)
    for r in rows:
        out[r["row"] * 4096:(r["row"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def _hits(bitmap: np.ndarray, bits: int, sizes: list[int]):
    """Lines ``file, line_no, text`` to their hits ``file, line_no, size, piece``."""
    def on(piece, size, factor):
        at = _bit(piece, size, factor, bits)
        return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def find(batches):
        for b in batches:
            text = b.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            low, high = (int(offsets[0]), int(offsets[-1])) if len(text) else (0, 0)
            raw = text.buffers()[2]
            data = np.concatenate([np.frombuffer(raw, np.uint8)[low:high], np.zeros(8, np.uint8)]) if high > low else np.zeros(8, np.uint8)
            ends = offsets[1:] - low
            found: dict[str, list] = {"row": [], "size": [], "piece": []}
            for start in range(0, high - low, _STEP):
                stop = min(start + _STEP, high - low)
                windows = _windows(data, start, stop)
                for size in sizes:
                    piece = windows & _mask(size)
                    at = np.flatnonzero(on(piece, size, _FACTORS[0]))
                    for factor in _FACTORS[1:]:
                        at = at[on(piece[at], size, factor)]
                    row = np.searchsorted(ends, at + start, "right")
                    inside = at + start + size <= ends[row]
                    rows = np.unique(np.stack([row[inside].astype(np.uint64), piece[at[inside]]]), axis=1)
                    found["row"].append(rows[0].astype(np.int64))
                    found["piece"].append(rows[1].view(np.int64))
                    found["size"].append(np.full(rows.shape[1], size, np.int32))
            if found["row"]:
                row = pa.array(np.concatenate(found["row"]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.concatenate(found["size"])),
                                                  pa.array(np.concatenate(found["piece"]))], names=["file", "line_no", "size", "piece"])
    return find


def substring_join(logs: DataFrame, needles: DataFrame, column: str) -> DataFrame:
    """Rows of ``logs`` (plus ``_needle``) whose ``column`` contains a needle of the same file;
    ``needles`` is ``(file, _needle)``. An empty needle finds nothing.

    ``logs`` is keyed by ``(file, line_no)``; rows that share a key are all tried. Each needle picks the
    piece that fewest needles have. The log is read for its text first, then once more for the lines that
    met a needle's piece; both small tables are written, so the planner broadcasts them by their true size.
    """
    spark = logs.sparkSession
    ship_package(spark)
    needles = needles.where(F.col("_needle") != "").distinct()
    pieces = needles.select("file", "_needle").mapInArrow(_needle_pieces, "file string, _needle string, size int, piece bigint")
    often = pieces.groupBy("file", "size", "piece").agg(F.count(F.lit(1)).alias("_n"))
    picked = sized(pieces.join(often, ["file", "size", "piece"]).groupBy("file", "_needle").agg(
        F.min(F.struct("_n", "size", "piece")).alias("p")).select("file", "_needle", "p.size", "p.piece"), "needles")
    known = picked.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()  # GRAM sizes at most
    bits = min(max(1 << (known["n"] * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    bitmap = piece_bitmap(picked, bits)
    line = logs.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.col(column).cast("binary").alias("text")).where("text is not null")
    hits = line.mapInArrow(_hits(bitmap, bits, sorted(known["sizes"])), "file string, line_no bigint, size int, piece bigint")
    met = sized(hits.join(picked, ["file", "size", "piece"]).select(F.col("file").alias("_file"), F.col("line_no").alias("_line"), "_needle").distinct(), "met")
    same = (F.col("file") == F.col("_file")) & (F.col("line_no") == F.col("_line"))
    return logs.join(met, same).where(F.col(column).contains(F.col("_needle"))).select(*logs.columns, "_needle")
