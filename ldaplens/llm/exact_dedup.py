"""Operator 6: exact dedup by an extendible-hash index on shared files.

The key space is cut into ranges by the top bits of the key; one owner task handles a range. Inside
it, a directory of pointers is indexed by the low bits of the key; a bucket that gets too full is split
and the directory doubles where the bucket's depth has reached its own. Different texts with equal keys
chain in their bucket and are told apart by their bytes. A range is one file: a row group for each
bucket, the directory in the file's metadata. Later batches are inserted into the files of before.
"""

from __future__ import annotations

import json
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ldaplens.llm import common
from ldaplens.session import scratch_path

#: Entries of a bucket before it is split, and bytes of text that an owner task holds at a time.
BUCKET = 256
RANGE_BYTES = 32 << 20

#: Bytes of repeated texts that a task holds to send each once, and replaced rows an owner lets stay.
HOT_BYTES = 16 << 20
SLACK = 1000

#: No bucket is split on more bits; more equal low bits than that chain.
DEEPEST = 40

ENTRY = pa.schema([("key", pa.int64()), ("text", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class Directory:
    """The buckets of one range in memory: ``key -> chain of entries``."""

    def __init__(self, capacity: int = BUCKET):
        self.capacity, self.depth = capacity, 0
        self.slots: list[list] = [[0, {}]]  # a bucket: its depth, its chains by key

    def chain(self, key: int) -> list:
        """The chain of ``key``, made in its bucket (after splitting it while it is full)."""
        while True:
            bucket = self.slots[key & ((1 << self.depth) - 1)]
            if (found := bucket[1].get(key)) is not None:
                return found
            if len(bucket[1]) < self.capacity or bucket[0] >= DEEPEST:
                return bucket[1].setdefault(key, [])
            self.split(bucket)

    def split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.slots += self.slots  # the directory doubles; both halves point to the same buckets
            self.depth += 1
        bit = 1 << bucket[0]
        low = [bucket[0] + 1, {k: v for k, v in bucket[1].items() if not k & bit}]
        high = [bucket[0] + 1, {k: v for k, v in bucket[1].items() if k & bit}]
        first = next(i for i, b in enumerate(self.slots) if b is bucket)
        for i in range(first & (bit - 1), len(self.slots), bit):
            self.slots[i] = high if i & bit else low

    def buckets(self) -> list[list]:
        return list({id(b): b for b in self.slots}.values())

    def put(self, key: int, text: str, entry_id, n: int, place) -> list:
        """Add ``n`` copies of a text whose largest id is ``entry_id``; equal bytes share an entry, which
        is returned."""
        chain = self.chain(key)
        for entry in chain:
            if entry[0] == text:
                entry[2] += n
                if entry[1] is None or entry_id is not None and entry_id > entry[1]:
                    entry[1], entry[3] = entry_id, place
                return entry
        chain.append([text, entry_id, n, place])
        return chain[-1]

    def entries(self):
        return (e for b in self.buckets() for chain in b[1].values() for e in chain)

    def save(self, uri: str) -> None:
        import pyarrow.parquet as pq

        from ldaplens.llm.store import publish

        found = self.buckets()
        number = {id(b): i for i, b in enumerate(found)}
        about = {b"depth": str(self.depth).encode(), b"slots": json.dumps([number[id(b)] for b in self.slots]).encode()}

        def write(out):
            with pq.ParquetWriter(out, ENTRY.with_metadata(about), compression="zstd") as w:
                for b in found:
                    rows = [(k, e[0], e[1], e[2]) for k, chain in b[1].items() for e in chain]
                    w.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([],) * 4, ENTRY)], schema=ENTRY.with_metadata(about)))

        publish(uri, write)

    @classmethod
    def load(cls, uri: str, capacity: int = BUCKET) -> Directory:
        """The directory of a file; one that no batch has reached yet is empty."""
        import pyarrow.parquet as pq

        from ldaplens.llm.store import opened

        out = cls(capacity)
        place, path = opened(uri)
        if place.get_file_info(path).is_file:
            with place.open_input_file(path) as f:
                for k, text, keep, n in zip(*(c.to_pylist() for c in pq.read_table(f).columns)):
                    out.put(k, text, keep, n, None)
        return out


def new_index(docs: DataFrame, text_col: str = "text", capacity: int = BUCKET, range_bytes: int = RANGE_BYTES) -> dict:
    """An empty index: a folder in the shared folder, and as many ranges as the texts of ``docs``
    need for ``range_bytes`` each, at least two for each core."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-size // range_bytes))
    return {"root": scratch_path(spark, "index"), "bits": (ranges - 1).bit_length(), "capacity": capacity, "version": 0}


def insert(docs: DataFrame, index: dict, id_col: str = "doc_id", text_col: str = "text", key=F.xxhash64) -> tuple[DataFrame, dict]:
    """Insert a batch: ``(survivors, index after it)``.

    ``survivors`` has one row for each distinct text of the batch, unless an earlier batch holds the
    text under a larger id: ``row`` (the other columns of the row that stays, as a struct), ``text``,
    ``text_sha256, keep_id, group_size`` (earlier batches included). A text that occurs twice in an
    Arrow batch is held by the task and sent once (once a batch where the held ones outgrow
    ``HOT_BYTES``), so a group that holds a third of all rows costs a row a task; its owner holds the one
    row that stays.
    """
    spark = docs.sparkSession
    common.python_ready(spark)
    bits, capacity, root = index["bits"], index["capacity"], index["root"]
    before, after = f"{root}/v{index['version']}", f"{root}/v{index['version'] + 1}"
    key_of: Column = key(F.col("text"))
    rest = [c for c in docs.columns if c != text_col]
    slim = docs.select(F.struct(*rest).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", key_of)
    slim = slim.withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")).withColumn("n", F.lit(1).cast("long"))

    def combine(batches):
        hot: dict[str, list] = {}  # text -> its row with the largest id so far, that id, copies
        room = HOT_BYTES
        for b in batches:
            ids, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            best: dict[str, int] = {}
            count: dict[str, int] = {}
            for i, t in enumerate(texts):
                j = best.setdefault(t, i)
                count[t] = count.get(t, 0) + 1
                if ids[i] is not None and (ids[j] is None or ids[i] > ids[j]):
                    best[t] = i
            for t in [t for t, n in count.items() if n > 1 or t in hot]:
                i, n = best[t], count[t]
                held = hot.get(t)
                if held is None:
                    if 4 * len(t) > room:
                        continue
                    room -= 4 * len(t)
                    hot[t] = [b.take(pa.array([i], pa.int64())), ids[i], n]
                else:
                    held[2] += n
                    if ids[i] is not None and (held[1] is None or ids[i] > held[1]):
                        held[0], held[1] = b.take(pa.array([i], pa.int64())), ids[i]
                del best[t]
            kept = b.take(pa.array(best.values(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:5], pa.array([count[t] for t in best], pa.int64())], schema=kept.schema)
        for one, _, n in hot.values():
            yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([n], pa.int64())], schema=one.schema)

    def own(batches):
        from ldaplens.llm.exact_dedup import Directory

        def kept(rows, places, number):
            """The rows at ``places`` (entries in ``rows``), copied; the entries point to them."""
            out = rows.take(pa.array([e[3][1] for e in places], pa.int64()))
            for i, e in enumerate(places):
                e[3] = number, i
            return out

        def shrunk(directory, held):
            """Without the rows that a larger id has replaced."""
            live: dict[int, list] = {}
            for e in directory.entries():
                if e[3]:
                    live.setdefault(e[3][0], []).append(e)
            return [kept(held[p], es, i) for i, (p, es) in enumerate(live.items())]

        def finish(number, directory, held):
            directory.save(f"{after}/{number:08x}.parquet")
            stay: dict[int, list] = {}
            for e in directory.entries():
                if e[3]:
                    stay.setdefault(e[3][0], []).append(e)
            for p, es in stay.items():
                columns = [pa.array(c, kind) for c, kind in (([e[0] for e in es], pa.string()), ([sha256(e[0].encode()).hexdigest() for e in es], pa.string()),
                                                             ([e[1] for e in es], pa.int64()), ([e[2] for e in es], pa.int64()))]
                rows = held[p].take(pa.array([e[3][1] for e in es], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, *columns], names=["row", "text", "text_sha256", "keep_id", "group_size"])

        number, directory, held = None, None, []
        for b in batches:
            owner = b.column(4).to_pylist()
            start = 0
            for i in range(1, len(owner) + 1):  # the rows come sorted by range
                if i < len(owner) and owner[i] == owner[start]:
                    continue
                if owner[start] != number:
                    if directory is not None:
                        yield from finish(number, directory, held)
                    number, held, rows, texts = owner[start], [], 0, set()
                    directory = Directory.load(f"{before}/{number:08x}.parquet", capacity)
                part = b.slice(start, i - start)
                touched = {}
                for at, (one, text, k, n) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3, 5)))):
                    entry = directory.put(k, text, one, n, (len(held), at))
                    if entry[3] and entry[3][0] == len(held):
                        touched[id(entry)] = entry
                if touched:
                    texts |= touched.keys()
                    rows += len(touched)
                    held.append(kept(part.column(0), list(touched.values()), len(held)))
                    if rows > 2 * len(texts) + SLACK:
                        held, rows = shrunk(directory, held), len(texts)
                start = i
        if directory is not None:
            yield from finish(number, directory, held)

    sent = slim.mapInArrow(combine, slim.schema).repartition("range").sortWithinPartitions("range")
    schema = slim.select("row", "text").schema.add("text_sha256", "string").add("keep_id", "long").add("group_size", "long")
    return sent.mapInArrow(own, schema), {**index, "version": index["version"] + 1}


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; ``kept`` once in a group.

    Null text counts as empty. A null id is less than any other; a group with no id has a null
    keep_id and still keeps one row. Of repeated rows with the id that stays, one is kept. An empty
    table gives no rows. The groups are joined back by digest; only digests and ids are moved for it.
    """
    slim = common.texts(docs, id_col, text_col)
    survivors, _ = insert(slim, new_index(slim, **{k: v for k, v in options.items() if k != "key"}), **{k: v for k, v in options.items() if k == "key"})
    groups = common.written(survivors.select("text_sha256", "keep_id", "group_size"), "groups")
    rows = slim.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    first = F.row_number().over(W.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0))) == 1
    rows = rows.withColumn("first", first)
    return rows.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"), "text_sha256")


#: Index folders of ``keep_one`` whose results may not be written yet.
_KEPT: list[str] = []


def drop_indexes() -> None:
    """Delete the index files behind the results of ``keep_one``, once these are written. A result that
    is computed later, or again, writes its files anew."""
    from pyarrow import fs

    from ldaplens.llm.store import opened

    while _KEPT:
        place, path = opened(_KEPT.pop())
        if place.get_file_info(path).type == fs.FileType.Directory:
            place.delete_dir(path)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each distinct text (the largest id), with exactly its columns. The
    surviving rows come from the owner tasks, so the texts are shuffled once. A null text that
    stays comes back empty. The index files stay until ``drop_indexes``."""
    index = new_index(docs, text_col)
    _KEPT.append(index["root"])
    survivors, _ = insert(docs, index, id_col, text_col)
    return survivors.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
