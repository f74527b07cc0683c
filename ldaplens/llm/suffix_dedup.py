"""Operator 8: removal of long repeated byte strings by a logarithmic family of suffix arrays.

Documents come in batches by id. A batch's suffix array holds the suffixes that start at sampled
places, sorted by their beginnings; it is merge-scanned with the levels of the family for strings met
before, and its new suffixes become a level of their own. Before a scan, levels of equal size merge, so
there are logarithmically many.

The sample: of the grams of ``length`` bytes' window the one with the least hash (the leftmost on ties) is
its anchor, so equal windows have equal anchors at equal places, and suffixes that start at no anchor
need no entry. Consecutive windows with one anchor are a *segment*. Its entry is (hash of the anchor's
gram, hash of all bytes of the segment). Equal entries are repeats as a whole. Different entries with
the same gram may share some windows; only for these are the bytes themselves fetched and compared.
"""

from __future__ import annotations

from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common

#: Batches of a call; the family then holds one level for each binary digit of their number.
BATCHES = 4
#: Windows of a text that are sampled at a time.
CHUNK = 1 << 22
#: Entries a task remembers, to keep repeats of its own documents out of the shuffle.
SEEN = 100_000
#: Entries after which a task hands on what it has.
FLUSH = 30_000
#: Rows in an Arrow batch of entries.
SCAN_ROWS = 2000
#: Segments with the same gram whose windows a task compares in memory, about 100 MB of windows at
#: most; those of larger groups go through files, by their hashes, in as many classes.
GROUP = 8192
CLASSES = 64

#: ``place`` holds a run of windows in a document: the first one, then how many follow it.
ROWS = "gram long, body long, doc_id long, place long"
SCANNED = "kind int, gram long, body long, doc_id long, place long"
NEW, REPEAT, EDGE = 1, 2, 4  # kinds, as bits
MORE = 31  # bits of a place for the windows that follow
ORDER = ("gram", "body", "doc_id", "place")


def run_of(df: DataFrame) -> DataFrame:
    """``place`` as ``first, last``."""
    first = F.shiftright("place", MORE)
    return df.withColumns({"first": first.cast("int"), "last": (first + F.col("place").bitwiseAND(F.lit((1 << MORE) - 1))).cast("int")}).drop("place")


@cache
def byte_codes():
    import numpy as np

    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_size(length: int) -> int:
    """The largest power of two up to a third of ``length``."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def segments(data: bytes, length: int):
    """``(gram hash, first window, last window)`` of all segments, as arrays."""
    import numpy as np

    k = gram_size(length)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty
    low = np.uint64((1 << 26) - 1)
    found = []
    for at in range(0, len(data) - length + 1, CHUNK):
        h = byte_codes()[np.frombuffer(data[at : at + CHUNK + length - 1], np.uint8)]
        n = 1
        while n < k:
            h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
            n *= 2
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(29))
        least = h & ~low | np.arange(len(h), dtype=np.uint64)
        grams, n = length - k + 1, 1  # of a window
        while 2 * n <= grams:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < grams:
            least = np.minimum(least[: n - grams], least[grams - n :])
        anchor = (least & low).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut - 1, len(anchor) - 1]
        found.append((h[anchor[first]].view(np.int64), first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found))


def _entries(docs: DataFrame, length: int) -> DataFrame:
    """``ROWS`` of a batch: the entry of each segment. What a task has seen at a smaller place goes
    as a finished repeat (``body`` null), and a whole copy as one: hot groups cost a row a task."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        from ldaplens.llm.suffix_dedup import segments

        seen: dict = {}
        copies: dict = {}
        out: tuple[list, ...] = ([], [], [], [])

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=list(ORDER))
            for column in out:
                column.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = text.encode()
                if doc is None or len(data) < length:
                    continue
                whole = (xxh3_64_intdigest(data), len(data), data[:32])
                before = copies.setdefault(whole, doc)
                if before < doc:
                    rows = [(doc, None, doc, len(data) - length)]
                else:
                    copies[whole] = doc
                    rows = []
                    for gram, first, last in zip(*(x.tolist() for x in segments(data, length))):
                        body = xxh3_64_intdigest(data[first : last + length]) - (1 << 63)
                        place = first << MORE | last - first
                        if seen.setdefault((gram, body), (doc, place)) < (doc, place):
                            rows.append((doc, None, doc, place))
                        else:
                            seen[gram, body] = (doc, place)
                            rows.append((gram, body, doc, place))
                for column, values in zip(out, zip(*rows)):
                    column += values
                if len(seen) > SEEN:
                    seen.clear()
                if len(copies) > SEEN:
                    copies.clear()
                if len(out[0]) >= FLUSH:
                    yield flush()
        if out[0]:
            yield flush()

    return docs.mapInArrow(run, ROWS)


def _scan(rows: DataFrame, low: int | None, keep_new: bool) -> DataFrame:
    """The merge-scan: ``SCANNED`` rows from a batch's entries and those of all levels (ids up to
    ``low``), which meet sorted by gram, body and place. The first entry of a body is new unless it
    is a level's, the others repeat it (but for one at the very same place, from a repeated row);
    where a gram has several bodies their first entries are edges. A gram's entries are passed on as
    they come, one is held back at most. Entries that are only new go out if ``keep_new``."""
    new = NEW if keep_new else 0

    def run(batches):
        import numpy as np

        state = None  # gram, body of the last row; whether the gram has several; its first entry if not; the last place
        names = ["kind", *ORDER]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
        for b in batches:
            repeat = b.filter(b.column(1).is_null())
            if len(repeat):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(repeat), REPEAT, np.int32)), *repeat.columns], names=names)
            b = b.filter(b.column(1).is_valid())
            if not len(b):
                continue
            gram, body, doc, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            old = doc <= low if low is not None else np.zeros(len(doc), bool)
            new_gram = np.r_[state is None or state[0] != gram[0], gram[1:] != gram[:-1]]
            new_body = new_gram | np.r_[state is None or state[1] != body[0], body[1:] != body[:-1]]
            group = np.cumsum(new_gram) - new_gram[0]  # 0: the gram of the row before, if it goes on
            bodies = np.bincount(group, weights=new_body).astype(int)
            goes_on = not new_gram[0]
            several = bodies > 1
            if goes_on:
                several[0] = state[2] or state[3] is not None and bodies[0] > 0
            held = state[3] if state else None
            end = group[-1]
            if held is not None and (not goes_on or several[0] or end > 0):  # its gram has ended or has several
                kind = (0 if held[3] else new) | (EDGE if goes_on and several[0] else 0)
                if kind:
                    yield done(([kind], [state[0]], [held[0]], [held[1]], [held[2]]))
                held = None
            at = (int(doc[-1]), int(place[-1]))
            twice = ~new_body & np.r_[state is not None and state[4] == (doc[0], place[0]), (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])]
            kind = np.where(new_body, np.where(old, 0, new) | np.where(several[group], EDGE, 0), np.where(old | twice, 0, REPEAT)).astype(np.int32)
            if not several[end] and (lone := np.flatnonzero(new_body & (group == end))).size:
                i = int(lone[0])  # the last gram's only body so far: what it is turns out later
                held = (int(body[i]), int(doc[i]), int(place[i]), bool(old[i]))
                kind[i] = 0
            state = (int(gram[-1]), int(body[-1]), bool(several[end]), held, at)
            keep = kind > 0
            if keep.any():
                yield done((kind[keep], gram[keep], body[keep], doc[keep], place[keep]))
        if new and state and state[3] is not None and not state[3][3]:
            held = state[3]
            yield done(([NEW], [state[0]], [held[0]], [held[1]], [held[2]]))

    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SCAN_ROWS))
    return rows.repartition("gram").sortWithinPartitions(*ORDER).mapInArrow(run, SCANNED)


def _has(df: DataFrame, bits: int) -> DataFrame:
    return df.where(F.col("kind").bitwiseAND(F.lit(bits)) > 0)


class Family:
    """Levels of entries in the shared folder, each with the number of batches that it holds."""

    def __init__(self, spark):
        self.spark, self.levels = spark, []  # (batches, entries, the table they are in)

    def merge(self) -> None:
        """Merge levels of equal size, smallest first; their tables are deleted."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            parts = self.levels[-2:]
            both = parts[0][1].union(parts[1][1]).repartition("gram").sortWithinPartitions(*ORDER)
            whole = common.written(both, "suffix-level")
            self.levels[-2:] = [(2 * parts[0][0], whole, whole)]
            for _, _, table in parts:
                common.remove(table)
            common.forget(self.spark)

    def scan(self, entries: DataFrame, low: int | None, keep: bool = True) -> DataFrame:
        """Merge-scan a batch's entries, whose ids lie above ``low``, and keep its new ones as a level
        if more batches are to come; its repeats and edges."""
        self.merge()
        rows = reduce(DataFrame.union, [t for _, t, _ in self.levels], entries)
        found = common.written(_scan(rows, low, keep), "suffix-scan")
        common.python_ready(self.spark)
        del rows
        if not keep:
            common.forget(self.spark)
            return found
        self.levels.append((1, _has(found, NEW).drop("kind"), found))
        told = common.written(_has(found, REPEAT | EDGE), "suffix-told")
        common.forget(self.spark)
        return told

    def drop(self) -> None:
        """Delete the levels."""
        for _, _, table in self.levels:
            common.remove(table)
        self.levels.clear()


def _edge_rows(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """``gram, doc_id, first, bytes`` of the edges: the bytes of all their windows."""

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text, found in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode()
                for e in found:
                    row = (e["gram"], doc, e["first"], data[e["first"] : e["last"] + length])
                    for column, v in zip(out, row):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["gram", "doc_id", "first", "content"])

    lists = edges.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "first", "last")).alias("found"))
    return docs.join(lists, "doc_id").select("doc_id", "text", "found").mapInArrow(run, "gram long, doc_id long, first int, content binary")


class Spool:
    """The windows of a group of any size: their hashes lie in the task's temporary folder, in classes
    by hash that are sorted one at a time; of a segment only its place is held."""

    def __init__(self, length: int):
        from array import array
        from tempfile import TemporaryFile

        self.length, self.n, self.hashes = length, 0, []
        self.places = tuple(array("q") for _ in range(3))  # of segments: document, first window, number of the first
        self.files = [TemporaryFile() for _ in range(CLASSES)]

    def add(self, doc: int, first: int, content: bytes) -> None:
        from xxhash import xxh3_64_intdigest

        for column, v in zip(self.places, (doc, first, self.n + len(self.hashes))):
            column.append(v)
        self.hashes += [xxh3_64_intdigest(content[i : i + self.length]) for i in range(len(content) - self.length + 1)]
        if len(self.hashes) >= FLUSH:
            self.flush()

    def flush(self) -> None:
        import numpy as np

        h = np.array(self.hashes, np.uint64)
        rows = np.stack([h, np.arange(self.n, self.n + len(h), dtype=np.uint64)], axis=1)
        kind = h % np.uint64(CLASSES)
        rows = rows[np.argsort(kind, kind="stable")]
        cuts = np.cumsum(np.bincount(kind.astype(np.int64), minlength=CLASSES))[:-1]
        for f, part in zip(self.files, np.split(rows, cuts)):
            f.write(part.tobytes())
        self.n += len(h)
        self.hashes.clear()

    def runs(self):
        """``doc_id, first, last`` of the runs of windows that also come earlier, as arrays."""
        import numpy as np

        self.flush()
        doc, first, start = (np.frombuffer(c, np.int64) for c in self.places)
        told = np.zeros(self.n + 1, bool)
        for f in self.files:
            f.seek(0)
            h, number = np.frombuffer(f.read(), np.uint64).reshape(-1, 2).T
            f.close()
            if not len(h):
                continue
            number = number.astype(np.int64)
            segment = np.searchsorted(start, number, "right") - 1
            docs, at = doc[segment], first[segment] + number - start[segment]
            order = np.lexsort((at, docs, h))
            h, number, docs, at = h[order], number[order], docs[order], at[order]
            least = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            least = np.repeat(least, np.diff(np.r_[least, len(h)]))
            told[number[(docs != docs[least]) | (at != at[least])]] = True  # the same place is a repeated row
        begins = np.zeros(self.n + 1, bool)
        begins[start] = begins[-1] = True
        a = np.flatnonzero(told & (begins | ~np.r_[False, told[:-1]]))
        z = np.flatnonzero(told[:-1] & (begins[1:] | ~told[1:]))
        segment = np.searchsorted(start, a, "right") - 1
        at = first[segment] - start[segment]
        return doc[segment], at + a, at + z


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows among segments with the same gram: ``doc_id, first, last``.

    A group of up to ``GROUP`` segments is compared by its bytes, in order of place, the windows of a
    larger one by their hashes. Either way a task gives the runs, no rows of single windows."""

    def run(batches):
        from ldaplens.llm.suffix_dedup import Spool

        names = ["doc_id", "first", "last"]
        kinds = (pa.int64(), pa.int32(), pa.int32())
        out: tuple[list, ...] = ([], [], [])

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for column in out:
                column.clear()
            return b

        def put(*row):
            for column, v in zip(out, row):
                column.append(v)

        def compared(group):
            seen: dict = {}
            for _, doc, first, content in group:  # sorted by place
                start = None
                for i in range(len(content) - length + 1):
                    if seen.setdefault(content[i : i + length], (doc, first + i)) != (doc, first + i):
                        start = i if start is None else start
                    elif start is not None:
                        put(doc, first + start, first + i - 1)
                        start = None
                if start is not None:
                    put(doc, first + start, first + len(content) - length)

        def ended():
            if not spool:
                compared(group)
                return
            found = spool.runs()
            for i in range(0, len(found[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], k) for c, k in zip(found, kinds)], names=names)

        group, spool = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][0] != row[0]:
                    yield from ended()
                    group, spool = [], None
                if spool:
                    spool.add(*row[1:])
                    continue
                group.append(row)
                if len(group) > GROUP:
                    spool = Spool(length)
                    for r in group:
                        spool.add(*r[1:])
                    group = group[:1]
                if len(out[0]) >= 20_000:
                    yield flush()
        if group:
            yield from ended()
        if out[0]:
            yield flush()

    return rows.repartition("gram").sortWithinPartitions("gram", "doc_id", "first").mapInArrow(run, "doc_id long, first int, last int")


def repeats(docs: DataFrame, length: int = 100, batches: int = BATCHES) -> DataFrame:
    """``doc_id, first, last``: runs of windows that also start earlier. ``docs``: ``doc_id, text``."""
    spark = docs.sparkSession
    bounds = docs.where("doc_id is not null").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(x) for x in bounds}), None]
    family, scans = Family(spark), []
    for low, high in zip(bounds, bounds[1:]):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        scans.append(family.scan(_entries(part, length), low, keep=high is not None))
    family.drop()
    told = reduce(DataFrame.union, scans)
    found = run_of(_has(told, REPEAT)).select("doc_id", "first", "last")
    edges = run_of(_has(told, EDGE).select("gram", "doc_id", "place").distinct())
    content = common.written(_edge_rows(docs, edges, length), "suffix-edges")
    common.forget(spark)
    windows = common.written(_windows(content, length), "suffix-windows")
    return found.union(windows)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary): each document without the bytes covered
    by a string of ``length`` bytes that also starts earlier, in a smaller id or before in the same.

    Null text counts as empty; texts shorter than ``length`` have no such string. Rows without an id
    match nothing and stay whole. Rows that repeat an id count as one document: what is removed
    from one is removed, up to its length, from all. An empty table gives no rows; other columns
    are ignored. Results are judged on the input, so batches and their number don't change them.
    """
    spark = docs.sparkSession
    common.python_ready(spark)
    slim = common.texts(docs, id_col, text_col)
    runs = common.written(repeats(slim, length, batches), "suffix-repeats")
    common.forget(spark)
    lists = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(tables):
        for b in tables:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, found in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode()
                spans: list = []
                for first, last in sorted((r["first"], r["last"]) for r in found or ()):
                    end = min(last + length, len(data))
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    elif first < end:
                        spans.append([first, end])
                kept, at = [], 0
                for first, end in spans:
                    kept.append(data[at:first])
                    at = end
                kept.append(data[at:])
                row = (doc, len(data), sum(e - f for f, e in spans), len(spans), b"".join(kept))
                for column, v in zip(out, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (*[pa.int64()] * 4, pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return slim.join(lists, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
