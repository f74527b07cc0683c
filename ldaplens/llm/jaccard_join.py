"""Operator 9: n-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into a bit sketch: every shingle flips one bit, so the
Hamming distance of two sketches is at most the sets' symmetric difference. Documents are sketched per
size band; a band's pairs differ in at most ``t`` shingles, so cut into more than ``t`` parts, two
sketches agree on a part. Parts are joined by equality, candidates verified on the exact sets.

No pairs are made of large groups. A part's content is *common* if more than ``FEW`` sets have it. A set
that still has over ``t`` parts of its own finds every partner in small groups; only the others, copies
of much copied texts, go on to a second join on single shingles, and those that are made of common
shingles only are linked to the centre of their group. Pairs across what is then still apart are checked.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common
from ldaplens.llm.components import components

#: Sets in a group whose pairs are all made.
FEW = 4
#: Bits of a part of the sketch.
PART_BITS = 1 << 16
#: About the bytes of sets that one task holds at a time to verify pairs; a single pair may have more.
HOME_BYTES = 16_000_000
#: Rows in an Arrow batch of keys.
KEY_ROWS = 2000
#: About the bytes of texts that are shingled together; a single text may have more.
GROUP_BYTES = 1 << 19
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 64


def mix(x):
    """A fixed 64-bit mixing of an unsigned array."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes):
    """64-bit hashes of the words of ``raw``, lowered bytes, and the place of each. All words are hashed
    together, eight bytes at a time; those over ``LONG_WORD`` one by one."""
    import numpy as np
    from xxhash import xxh64_intdigest

    padded = b"\n" + raw + b"\n" * 8
    b = np.frombuffer(padded, np.uint8)
    gap = (b == 32) | (b - np.uint8(9) <= 4)  # the six ASCII white spaces
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(b) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    rows = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        left = size[rows] - at
        inside = eight[first[rows] + at] << (64 - 8 * np.minimum(left, 8)).astype(np.uint64)
        h[rows] = mix(h[rows] * np.uint64(0x9E3779B97F4A7C15) + inside)
        rows = rows[left > 8]
        if not len(rows):
            break
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxh64_intdigest(padded[first[i] : first[i] + size[i]])
    return h, first - 1


def shingle_sets(texts, words: int):
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words; a shorter text is
    one shingle, a text without words none. Gives lists, each of the next texts of about ``GROUP_BYTES``."""
    some, size = [], 0
    for t in texts:
        some.append(t.encode())
        size += len(some[-1])
        if size >= GROUP_BYTES:
            yield _shingled(some, words)
            some, size = [], 0
    if some:
        yield _shingled(some, words)


def _shingled(texts: list[bytes], words: int) -> list:
    import numpy as np

    h, place = word_hashes(b"\n".join(texts).lower())  # of bytes: A-Z only
    upto = np.searchsorted(place, np.cumsum([len(t) + 1 for t in texts]))
    count = np.diff(upto, prepend=0)
    each = np.where(count < words, np.minimum(count, 1), count - words + 1)
    stop = np.cumsum(each)
    at = np.arange(stop[-1]) + np.repeat(upto - count - (stop - each), each)  # the first word of every shingle
    n = np.repeat(np.minimum(count, words), each)
    total, short = n.astype(np.uint64), (count < words).any()
    for k in range(words):
        more = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, len(h) - 1)])
        total = np.where(k < n, more, total) if short else more
    for i, j in zip(stop - each, stop):
        total[i:j].sort()
    new = np.ones(len(total) + 1, bool)
    np.not_equal(total[1:], total[:-1], out=new[1:-1])
    new[stop] = True
    upto = np.concatenate([[0], np.cumsum(new[:-1])])
    total = total[new[:-1]]
    return [total[i:j] for i, j in zip(upto[stop - each], upto[stop])]


class Bands:
    """Size bands for a similarity of ``percent``: band s holds pairs whose larger set has
    ``low[s] <= size <= high[s]``; they differ in at most ``differ[s]`` shingles. There are as many as
    ``largest`` takes, more shingles than a text can have; ``bits`` hold a band's number and one bit. At
    100 percent there are none, as only equal sets are linked."""

    def __init__(self, percent: int, largest: int = 1 << 30):
        self.percent, self.low, self.high, self.differ = percent, [], [], []
        low = 1
        while low <= largest and percent < 100:
            high = max(low, low * 100 // percent)
            self.low.append(low)
            self.high.append(high)
            self.differ.append(2 * high * (100 - percent) // (100 + percent))
            low = high + 1
        self.bits = max(8, len(self.low).bit_length() + 1)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of ``size`` can be part of a pair."""
        s = first = bisect_left(self.high, size)
        while s < len(self.low) and 100 * size >= self.percent * self.low[s]:
            s += 1
        return [x for x in range(first, s) if self.differ[x] > 0]

    def lacks(self, size: int, s: int) -> int:
        """The most shingles in which a set of ``size`` differs from a partner in band s, no larger than the
        band and the similarity allow. It is less than ``differ[s]`` for all but the band's largest sets."""
        partner = min(self.high[s], size * 100 // self.percent)
        return (size + partner) * (100 - self.percent) // (100 + self.percent)

    def cut(self, s: int) -> tuple[int, int]:
        """Parts of band s's sketch, and the set bits a part has to have to be worth joining."""
        need = self.differ[s] + 1
        return (8 * need // 5 + 1, 2) if self.high[s] >= 40 else (4 * need, 1)


@cache
def bands(percent: int) -> Bands:
    return Bands(percent)


def part_keys(tokens, s: int, b: Bands):
    """``(keys, spare)`` of a set in band s: see ``band_keys``."""
    keys, _, spare = band_keys([tokens], s, b)
    return keys, int(spare[0])


def band_keys(sets: list, s: int, b: Bands):
    """The keys of some sets in band s, how many each has, and each one's ``spare``. A key is the content of a
    part; its low ``b.bits`` hold the band and whether the part is full, that is has the least bits. Full parts
    alone are given if they outnumber what the set can differ in (by ``spare`` and one), else all parts, empty
    ones too, and -1."""
    import numpy as np

    parts, least = b.cut(s)
    sizes = [len(x) for x in sets]
    h = mix(np.concatenate(sets) + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    bit = h & np.uint64(PART_BITS - 1)
    h >>= np.uint64(20)
    h -= h // np.uint64(parts) * np.uint64(parts)
    at = (h + np.repeat(np.arange(len(sets), dtype=np.uint64) * np.uint64(parts), sizes)) * np.uint64(PART_BITS) + bit
    at.sort()
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at = at[first[np.diff(first, append=len(at)) & 1 == 1]]  # bits flipped an even number of times are off
    part = (at // np.uint64(PART_BITS)).astype(np.int64)
    content, bits = np.zeros(len(sets) * parts, np.uint64), np.bincount(part, minlength=len(sets) * parts)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        own = at - (part // parts * (parts * PART_BITS)).astype(np.uint64)
        content[part[first]] = np.add.reduceat(mix(own + np.uint64(1)), first)
    full = bits >= least
    spare = full.reshape(-1, parts).sum(1) - np.array([b.lacks(n, s) + 1 for n in sizes])
    content += np.tile(np.arange(parts, dtype=np.uint64), len(sets))
    keys = mix(content) & ~np.uint64((1 << b.bits) - 1) | np.uint64(s << 1) | full.astype(np.uint64)
    given = full | np.repeat(spare < 0, parts)
    return keys[given], given.reshape(-1, parts).sum(1), np.maximum(spare, -1)


def signature(tokens) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, sig, n``: the signature and the size of each document's set."""

    def run(batches):
        from ldaplens.llm.jaccard_join import shingle_sets, signature

        for b in batches:
            sigs, sizes = [], []
            for found in shingle_sets(b.column(1).to_pylist(), words):
                sigs += [signature(x) if len(x) else None for x in found]
                sizes += map(len, found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "sig", "n"])

    return docs.mapInArrow(run, "doc_id long, sig long, n long")


def _part_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``key, sig, spare`` of all sets; a task gives the rows of equal sets once."""

    def run(batches):
        import numpy as np

        from ldaplens.llm.jaccard_join import band_keys, bands, shingle_sets, signature

        b, seen = bands(percent), set()
        for found in chain.from_iterable(shingle_sets(batch.column(0).to_pylist(), words) for batch in batches):
            of = defaultdict(list)  # sets of each band, with their signatures
            for tokens in found:
                if not len(tokens) or (sig := signature(tokens)) in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(sig)
                for s in b.of(len(tokens)):
                    of[s].append((sig, tokens))
            if of:
                keys, sigs, spares = [], [], []
                for s, members in of.items():
                    k, n, spare = band_keys([tokens for _, tokens in members], s, b)
                    keys.append(k.view(np.int64))
                    sigs.append(np.repeat(np.array([sig for sig, _ in members], np.int64), n))
                    spares.append(np.repeat(spare.astype(np.int32), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, sigs, spares)], names=["key", "sig", "spare"])

    return docs.select("text").mapInArrow(run, "key long, sig long, spare int")


def _groups(rows: DataFrame, name: str) -> DataFrame:
    """``pair, key, a, b, spare`` from ``key, sig, spare``: all pairs ``a < b`` of the groups of two to
    ``FEW`` sets, with the larger spare of the two; and of larger groups the members ``a``. Each
    group is a run of sorted rows and never held whole."""
    spark = rows.sparkSession

    def run(batches):
        import numpy as np

        carry = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        large = None  # the key of a large group that goes on

        def cut(key, sig, spare, last):
            """Output for sorted rows; the last run is kept back unless ``last``."""
            nonlocal large, carry
            keep = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])] if len(key) else np.zeros(0, bool)
            key, sig, spare = key[keep], sig[keep], spare[keep]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            done = len(first) if last else max(0, len(first) - 1)
            out_k, out_a, out_b, out_s = [], [], [], []
            big = size > FEW
            if large is not None and len(first):
                big[0] |= key[0] == large
            for m in range(2, FEW + 1):
                at = first[:done][(size[:done] == m) & ~big[:done]]
                for i in range(m):
                    for j in range(i + 1, m):
                        out_k.append(key[at])
                        out_a.append(sig[at + i])
                        out_b.append(sig[at + j])
                        out_s.append(np.maximum(spare[at + i], spare[at + j]))
            pairs = sum(map(len, out_k))
            member = np.repeat(big, size)
            if not last and len(first):
                if not big[-1]:
                    member[first[-1] :] = False
                    carry, large = [key[first[-1] :], sig[first[-1] :], spare[first[-1] :]], None
                else:  # rows of a large group go out at once; its last one stays, to tell repeats
                    member[-1] = False
                    carry, large = [key[-1:], sig[-1:], spare[-1:]], int(key[-1])
            for out, column in ((out_k, key), (out_a, sig), (out_b, sig), (out_s, spare)):
                out.append(column[member])
            k, a, b, s = map(np.concatenate, (out_k, out_a, out_b, out_s))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(k)) < pairs), pa.array(k), pa.array(a), pa.array(b), pa.array(s, pa.int32())], names=["pair", "key", "a", "b", "spare"])

        for batch in batches:
            key, sig, spare = (np.concatenate([c, x.to_numpy(zero_copy_only=False)]) for c, x in zip(carry, batch.columns))
            if len(key):
                out = cut(key, sig, spare, False)
                if len(out):
                    yield out
        if len(carry[0]):
            yield cut(*carry, True)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(KEY_ROWS))
    out = common.written(rows.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(run, "pair boolean, key long, a long, b long, spare int"), name)
    common.python_ready(spark)
    common.forget(spark)
    return out


def _placed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, home, cut``: where each pair of sets that may be similar by their sizes is verified. Pairs meet at
    the least signature that their sets' partners have, so the sets of a group of copies are sent once, not once
    a pair; what would hold more than ``HOME_BYTES`` at a home is cut by the pair's hash."""
    size = lambda side: sets.select(F.col("sig").alias(side), F.col("n").alias(f"n_{side}")).distinct()
    near = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    pairs = common.written(pairs.join(size("a"), "a").join(size("b"), "b").where(near), "sized-pairs")
    reach = pairs.select(F.col("a").alias("sig"), "a").union(pairs.select("b", "a")).groupBy("sig").agg(F.min("a").alias("least"))
    for side in ("a", "b"):
        pairs = pairs.join(reach.select(F.col("sig").alias(side), F.col("least").alias(f"least_{side}")), side)
    pairs = pairs.select("a", "b", F.least("least_a", "least_b").alias("home"), (8 * (F.col("n_a") + F.col("n_b"))).alias("bytes"))
    cuts = pairs.groupBy("home").agg(F.ceil(F.sum("bytes") / HOME_BYTES).alias("cuts"))
    return pairs.join(cuts, "home").select("a", "b", "home", F.pmod(F.xxhash64("a", "b"), "cuts").alias("cut"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a < b`` whose sets are similar enough, by their exact intersection."""

    def run(batches):
        import numpy as np

        at, held = None, {}
        for batch in batches:
            a, b, keep = [], [], []
            for home, cut, one, other, tokens in zip(*(c if i == 4 else c.to_pylist() for i, c in enumerate(batch.columns))):
                if (home, cut) != at:
                    at, held = (home, cut), {}
                if other is None:
                    held[one] = np.frombuffer(tokens.as_py(), np.uint64)
                    continue
                x, y = held[one], held[other]
                both = len(np.intersect1d(x, y, assume_unique=True))
                a.append(one)
                b.append(other)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    placed = common.written(_placed(pairs, sets, percent), "placed")
    at = ["home", "cut"]
    needed = placed.select(*at, F.col("a").alias("sig")).union(placed.select(*at, "b")).distinct()
    rows = needed.join(sets, "sig").select(*at, F.col("sig").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = rows.union(placed.select(*at, "a", "b", F.lit(None).cast("binary")))  # the sets come first: their b is null
    return rows.repartition(*at).sortWithinPartitions(*at, F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _token_rows(sets: DataFrame) -> DataFrame:
    """``key, sig, spare``: every shingle of ``sets``, the unsettled ones. A set whose own shingles outnumber
    those that a partner may lack, ``size - ceil(percent * size)``, is settled."""

    def run(batches):
        import numpy as np

        for b in batches:
            found = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            size = [len(x) for x in found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(np.repeat(np.array(size, np.int32), size))], names=["key", "sig", "spare"])

    return sets.select("sig", "tokens").mapInArrow(run, "key long, sig long, spare int")


def similar_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: the size of each document's set, and the smallest id
    that it reaches by links of similarity ``percent`` or more (its own if none).

    A null text, or one without words, has an empty set and links with nothing. Texts shorter than
    ``words`` are one shingle. Null ids are not nodes: such rows get the component of equal sets'
    smallest id, else null. Repeated rows are repeated; an empty table gives no rows. Signatures and
    shingles are 64-bit hashes. Every link between different sets is found: see the module's text.
    """
    spark = docs.sparkSession
    common.python_ready(spark)
    common.forget(spark)  # the shuffle files of what came before
    slim = common.texts(docs, id_col, text_col)
    ids = common.written(_sets(slim, words), "sets-ids")
    nodes = ids.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("node"))

    # 1: parts of parity sketches
    first = _groups(_part_rows(slim, words, percent), "parts")
    band, full = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << bands(percent).bits) - 1)), 1), F.col("key").bitwiseAND(F.lit(1))
    counted = first.where("not pair").groupBy(F.col("a").alias("sig"), band.alias("band")).agg(F.sum(full).alias("n"), F.max("spare").alias("spare"))
    counted = common.written(counted, "common-parts")
    unsettled = common.written(counted.where("n > spare").select("sig").distinct(), "unsettled")
    # a linked pair shares more full parts than either set can spare; where both have common parts,
    # which make no pairs, any shared part will do
    met = first.where("pair").groupBy("a", "b", band.alias("band")).agg(F.sum(full).alias("n"), F.max("spare").alias("spare"))
    for side in ("a", "b"):
        met = met.join(counted.select(F.col("sig").alias(side), "band", F.col("n").alias(f"common_{side}")), [side, "band"], "left")
    likely = met.where("n > spare or (common_a is not null and common_b is not null)")
    pairs = common.written(likely.select("a", "b").distinct(), "pairs")
    common.remove(first)
    common.forget(spark)

    # the exact sets of those that take part in pairs or are unsettled
    partners = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).select("sig", F.lit(False).alias("open"))
    wanted = partners.union(unsettled.select("sig", F.lit(True))).groupBy("sig").agg(F.max("open").alias("open"))
    chosen = common.written(wanted.join(nodes, "sig").select(F.col("node").alias("doc_id"), "sig", "open"), "wanted")

    def tokens(batches):
        from ldaplens.llm.jaccard_join import shingle_sets, signature

        seen = set()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            texts, *others = (c.to_pylist() for c in b.columns)
            for found, sig, open_ in zip(chain.from_iterable(shingle_sets(texts, words)), *others):
                # another row with the same id may hold another set; of repeated rows a task gives one
                if sig not in seen and len(found) and signature(found) == sig:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(sig)
                    for column, v in zip(out, (sig, found.tobytes(), open_, len(found))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.bool_(), pa.int64()))], names=["sig", "tokens", "open", "n"])

    # the wanted ids grow with the corpus: a shuffle join at every size, no broadcast of the small ones
    texts = slim.join(chosen.hint("merge"), "doc_id").select("text", "sig", "open")
    sets = common.written(texts.mapInArrow(tokens, "sig long, tokens binary, open boolean, n long"), "sets")
    common.forget(spark)

    # 2: single shingles of the unsettled
    second = _groups(_token_rows(sets.where("open")), "tokens")
    more = second.where("pair").select("a", "b").distinct()
    members = second.where("not pair").select("key", F.col("a").alias("sig"), F.col("spare").alias("size"))
    lacks = F.col("size") - F.ceil(F.col("size") * percent / 100)
    shared = members.groupBy("sig").agg(F.count("*").alias("common"), F.max("size").alias("size"))
    hot = common.written(shared.where(F.col("size") - F.col("common") <= lacks).select("sig", (F.col("common") / F.col("size")).alias("near")), "hot")
    inside = common.written(members.join(hot, "sig"), "hot-tokens")

    # 3: those made of common shingles: a link to the most common-like set of a few of their groups
    centre = inside.groupBy("key").agg(F.max(F.struct("near", "sig")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    tops = inside.join(centre, "key").groupBy("sig").agg(F.max("top").alias("best"), F.min(F.struct("key", "top")).alias("any"))
    stars = tops.select("sig", F.explode(F.array(F.col("best.sig"), F.col("any.top.sig"))).alias("centre")).where("sig <> centre")
    stars = stars.select(F.least("sig", "centre").alias("a"), F.greatest("sig", "centre").alias("b")).distinct()
    tried = common.written(more.union(stars).distinct().join(pairs, ["a", "b"], "left_anti").union(pairs), "tried")
    common.remove(second)
    common.forget(spark)
    links = common.written(_linked(tried, sets, percent), "links")
    common.forget(spark)
    roots = components(links, "a", "b")

    # 4: pairs across what is still apart, by the rarest shingles of the smaller side
    placed = inside.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).where("r1 <> r2").select("key", "n")
    apart = common.written(placed.join(mixed, "key").select("key", "sig", "size", "root", "n"), "apart")
    if not apart.isEmpty():
        links = _across(apart, tried, sets, links, percent)
        roots = components(links, "a", "b")

    # the smallest id of each component
    of = nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = of.groupBy("root").agg(F.min("node").alias("component_id"))
    named = common.written(of.join(least, "root").select("sig", "component_id"), "named")
    out = ids.join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(apart: DataFrame, tried: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and those between sets of different components.

    Such a pair shares shingles of ``apart`` only: one that shares another is tried already, or of one
    component. So what a set can share is at most its ``count`` shingles there, which has to reach
    ``percent`` of its size, and in a pair ``percent / (100 + percent)`` of the sum of both sizes. A
    partner lacks ``count - ceil(percent * size)`` of them at most: by one order for all, rarest first,
    the two share one of the first ones of either, so these alone are joined; where they share
    their first one, what follows in both has to be enough still."""
    from pyspark.sql import Window as W

    weight = apart.select("sig", "root").distinct().groupBy("root").agg(F.count("*").alias("weight"))
    least = F.ceil(F.col("size") * percent / 100)
    rows = apart.withColumn("count", F.count("*").over(W.partitionBy("sig"))).where(F.col("count") >= least).join(weight, "root")
    probe = rows.withColumn("rank", F.row_number().over(W.partitionBy("sig").orderBy("n", "key"))).where(F.col("rank") <= F.col("count") - least + 1)
    side = lambda df, i: df.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("sig", "root", "weight", "size", "count", "rank")])
    lower = (F.col("weight1") < F.col("weight2")) | ((F.col("weight1") == F.col("weight2")) & (F.col("root1") < F.col("root2")))
    rest = F.least(F.col("count1") - F.col("rank1"), F.col("count2") - F.col("rank2")) + 1
    enough = rest * (100 + percent) >= percent * (F.col("size1") + F.col("size2"))
    left, right = side(probe, 1), side(probe, 2).withColumnRenamed("key", "key2")
    met = left.join(right, (F.col("key") == F.col("key2")) & lower & enough)
    pairs = met.select(F.least("sig1", "sig2").alias("a"), F.greatest("sig1", "sig2").alias("b")).distinct()
    fresh = common.written(pairs.join(tried, ["a", "b"], "left_anti"), "across")
    return links.union(common.written(_linked(fresh, sets, percent), "links"))


def keep_one_of_similar(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with exactly its columns. Rows
    without an id, and those without words, stay; rows that share an id stay or go together. The
    ids to drop are written, so the planner broadcasts them only if their size allows."""
    found = similar_components(docs, words, percent, id_col, text_col)
    drop = common.written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct(), "similar")
    return docs.join(drop, F.col(id_col) == F.col("__drop"), "left_anti")
