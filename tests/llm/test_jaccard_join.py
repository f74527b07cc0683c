import random

from ldaplens.llm.components import components
from ldaplens.llm.jaccard_join import Bands, part_keys, similar_components


def brute(rows, words, percent):
    sets, least = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
        sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, words=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_near_copies_around_the_threshold(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(120):  # one group, zero to eight edits from its base
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(60):  # chains: each is an edit of the one before
        w = texts[-1].split()
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(60):  # documents that share a passage only
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] + passage))
    for n in range(1, 40):  # short ones, and their copies with one word more
        w = [rng.choice(vocabulary[:50]) for _ in range(n)]
        texts += [" ".join(w), " ".join([*w, "more"]), " ".join(w).upper()]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))
    check(spark, list(enumerate(texts)), 5, 80)


def test_edges(spark):
    check(spark, [(3, None), (1, ""), (2, " \n\t"), (5, "a"), (4, "A"), (9, "a b c"), (8, "a\tB  c"), (7, "É b c d"), (6, "é b c d"), (10, "x " * 5000), (11, "x " * 4000)])
    empty = spark.createDataFrame([], "doc_id long, text string, sig long")
    assert similar_components(empty).columns == ["doc_id", "n_shingles", "component_id"]
    assert similar_components(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, similar_components(twice).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (None, 0, None), (None, 2, 1)]


def test_bands_cover_all_pairs():
    b = Bands(85)
    for larger in range(7, 400):
        for smaller in range(-(-85 * larger // 100), larger + 1):
            both = -(-85 * (larger + smaller) // 185)  # least intersection of a link
            differ = larger + smaller - 2 * both
            if both <= smaller and differ > 0:
                assert any(b.differ[s] >= differ for s in set(b.of(larger)) & set(b.of(smaller)))


def test_what_a_set_lacks_covers_all_its_partners():
    for percent in (80, 85):
        b = Bands(percent)
        for larger in range(7, 400):
            for smaller in range(-(-percent * larger // 100), larger + 1):
                both = -(-percent * (larger + smaller) // (100 + percent))
                differ = larger + smaller - 2 * both
                if both <= smaller and differ > 0:
                    s = next(s for s in range(len(b.high)) if b.low[s] <= larger <= b.high[s])
                    assert differ <= b.lacks(larger, s) <= b.differ[s] and differ <= b.lacks(smaller, s) <= b.differ[s]


def test_sets_of_every_size_settle_by_their_full_parts():
    """A set that has to give its empty parts, too, meets all others of its band and is never settled."""
    import numpy as np

    rng = np.random.default_rng(5)
    for percent in (80, 85):
        b = Bands(percent)
        for size in range(60, 2000, 37):
            tokens = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            assert all(part_keys(tokens, s, b)[1] >= 0 for s in b.of(size)), (percent, size)


def test_bands_reach_every_size(spark):
    for percent in (1, 50, 80, 85, 95, 99):
        b = Bands(percent)
        assert b.high[-1] >= 1 << 30 and b.of(1 << 29) and len(b.low) << 1 < 1 << b.bits
    assert Bands(100).of(5) == []
    rng = random.Random(6)
    rows = []
    for n in (60, 300, 2500, 9000):
        base = [f"w{rng.randrange(100_000)}" for _ in range(n)]
        for edits in (0, 1, 1, n // 300, n // 60):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"w{rng.randrange(100_000)}"
            rows.append((len(rows), " ".join(w)))
    for percent in (95, 99, 100):
        check(spark, rows, 4, percent)


def test_texts_are_hashed_in_groups(monkeypatch):
    """The steps of a group do not grow with its texts, and its sets and keys are those of each text alone."""
    from ldaplens.llm import jaccard_join as jj

    rng = random.Random(8)
    texts = ["", " \n\t", "a", "a\0", "a\0\0 \x1c\x85", "É B  c\td\x0be", " ".join("q" * i for i in range(90)), "one two one two one two"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 20) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    calls, mix = [], jj.mix
    monkeypatch.setattr(jj, "mix", lambda x: calls.append(len(x)) or mix(x))
    for words in (1, 4, 5):
        calls.clear()
        (found,) = jj.shingle_sets(texts, words)
        assert len(calls) <= words + jj.LONG_WORD // 8
        alone = [x for t in texts for (x,) in jj.shingle_sets([t], words)]
        assert [x.tolist() for x in found] == [x.tolist() for x in alone]
        sets = []
        for t in texts:
            w = t.encode().lower().split()
            sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
        assert [len(x) for x in found] == [len(x) for x in sets]
        assert len({x for f in found for x in f.tolist()}) == len(set().union(*sets))
        for i in rng.choices(range(len(texts)), k=200):
            assert len(set(found[i].tolist()) & set(found[i - 1].tolist())) == len(sets[i] & sets[i - 1])
    b = Bands(80)
    for s in range(len(b.low)):
        members = [x for x in found if s in b.of(len(x))]
        if members:
            calls.clear()
            keys, n, spare = jj.band_keys(members, s, b)
            assert len(calls) <= 3
            alone = [part_keys(x, s, b) for x in members]
            assert keys.tolist() == [k for x, _ in alone for k in x.tolist()]
            assert [(len(x), y) for x, y in alone] == list(zip(n.tolist(), spare.tolist()))
    monkeypatch.setattr(jj, "GROUP_BYTES", 100)
    groups = list(jj.shingle_sets(texts, 5))
    assert len(groups) > 50 and [x.tolist() for g in groups for x in g] == [x.tolist() for x in found]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (200, 200), (300, 100)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100, 300: 100, 200: 200}
