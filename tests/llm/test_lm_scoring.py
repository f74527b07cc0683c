import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ldaplens.llm import context_mixing as cm
from ldaplens.llm import lm_scoring
from ldaplens.llm.lm_scoring import score_texts, segments, words_of


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Model:
    """The model bit by bit, from dictionaries."""

    SPANS = (2, 3, 4)

    def __init__(self, texts, piece=cm.PIECE):
        self.piece = piece
        self.seen = [defaultdict(Counter) for _ in self.SPANS]
        for t in texts:
            for coded in self.pieces(t):
                for i in range(4, len(coded)):
                    for k, m in enumerate(self.SPANS):
                        self.seen[k][coded[i - m:i]][coded[i]] += 1

    def pieces(self, t):
        t = t.lower() if isinstance(t, bytes) else t.encode().lower()
        cuts = [t[a:a + self.piece] for a in range(0, len(t) + 1, self.piece)]
        return [b"\0\0\0\0" + c + (b"\xff" if c is cuts[-1] else b"") for c in cuts]

    def bits(self, coded, i):
        """Log odds of every predictor in favour of each bit of byte i, and its gate."""
        rows = [coded[i - m:i] for m in self.SPANS]
        out = []
        for level in range(8):
            shift = 8 - level
            x = []
            for k, ctx in enumerate(rows):
                node = {b: n for b, n in self.seen[k].get(ctx, {}).items() if b >> shift == coded[i] >> shift}
                yes = sum(n for b, n in node.items() if b >> (shift - 1) == coded[i] >> (shift - 1))
                x.append(math.log((yes + cm.DELTA) / (sum(node.values()) - yes + cm.DELTA)))
            out.append(x)
        return out, sum(sum(self.seen[2].get(rows[2], {}).values()) >= s for s in (1, 3, 16))

    def score(self, t):
        w = {(g, level): list(cm.START) for g in range(4) for level in range(8)}
        table = {(level, s): [cm.TRUST / (1 + math.exp(-(s + .5) / 2)) - cm.TRUST / 2, cm.TRUST] for level in range(8) for s in range(cm.STEPS)}
        total = 0.0
        for coded in self.pieces(t):
            at, n = 4, 0
            while at < len(coded):
                block = range(at, min(at + (64 << min(n // 8, 6)), len(coded)))
                at, n = block.stop, n + 1
                steps, notes, sizes = defaultdict(lambda: [0.0] * 3), [], Counter()
                for i in block:
                    rows, g = self.bits(coded, i)
                    sizes[g] += 1
                    for level, x in enumerate(rows):
                        z = sum(a * b for a, b in zip(x, w[g, level]))
                        p = 1 / (1 + math.exp(-z))
                        cell, side = (level, min(int(abs(z) * 2), cm.STEPS - 1)), (z > 0) - (z < 0)
                        total += math.log((p + .5 + side * table[cell][0] / table[cell][1]) / 2)
                        for k in range(3):
                            steps[g, level][k] += (1 - p) * x[k]
                        notes.append((cell, side))
                for (g, level), d in steps.items():
                    w[g, level] = [a + cm.RATE / (sizes[g] + cm.DAMP) * b for a, b in zip(w[g, level], d)]
                for cell, side in notes:
                    table[cell][0] += side / 2
                    table[cell][1] += 1
        return total / math.log(10)


def expected(rows, piece=cm.PIECE):
    texts = [(i, t or "") for i, t in rows]
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    words = lambda t: [*low(t).encode().split(), None]
    counts = Counter(w for i, t in texts if not held_out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    model = Model([t for i, t in texts if not held_out(i)], piece)
    return [(i, held_out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), model.score(t)) for i, t in texts]


def check(df, rows, piece=cm.PIECE):
    got = sorted((tuple(r)[:7] for r in score_texts(df).collect()), key=str)
    want = sorted(expected(rows, piece), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=2e-4, abs=1e-3)


def test_scores_equal_the_model_bit_by_bit(spark, odd):
    odd = odd.where("length(text) < 4000 or text is null")
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_random_texts_and_copies(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 5))) for _ in range(30)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 120))).capitalize()) for i in range(40)] + [(7, "copy of one text")] * 5
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_held_out_texts_teach_nothing(spark):
    rows = [(i, f"text {i} words words") for i in range(30)]
    train = [r for r in rows if not held_out(r[0])]
    scores = lambda rs: {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rs, "doc_id long, text string")).collect()}
    whole, less = scores(rows), scores(train + [r for r in rows if held_out(r[0])][:1])
    assert all(whole[i] == pytest.approx(s, rel=1e-6) for i, s in less.items())


def test_empty_and_only_held_out(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(empty).collect() == []
    rows = [(i, "never seen") for i in range(60) if held_out(i)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert all(-9 * 8 < r["score"] / 11 < 0 for r in got)


def test_a_long_text_goes_on_in_the_next_chunk(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["alpha", "beta", "gamma"], k=n)).encode() for n in (3, 400, 2, 150)]
    monkeypatch.setattr(cm, "PIECE", 1019)
    monkeypatch.setattr(cm, "CHUNK", 1024)
    chunks = list(lm_scoring._cut([(i, False, t) for i, t in enumerate(texts)]))
    assert [c[0] for c in [x for c in chunks for x in c if x[4] is not None]] == [0, 1, 2, 3]
    model = Model(texts, 1019)
    windows = np.concatenate([np.repeat(w, n) for w, n in (cm.Chunk([p for _, _, p, _, _ in c], [e for *_, e, _ in c]).distinct(
        np.ones(sum(len(p) + e for _, _, p, e, _ in c), bool)) for c in chunks)])
    keys, counts = np.unique(np.concatenate([cm.contexts(windows, k) for k in range(3)]), return_counts=True)
    predictors, totals, kept = cm.Predictors(keys, counts), defaultdict(float), None
    for c in chunks:
        state = cm.State(len(c))
        if kept:
            state.put(kept)
        lp = cm.score(cm.Chunk([x[2] for x in c], [x[3] for x in c]), predictors, state)
        for x, s in zip(c, lp):
            totals[x[0]] += s / math.log(10)
        kept = None if c[-1][3] else state.take(len(c) - 1)
    for i, t in enumerate(texts):
        assert totals[i] == pytest.approx(model.score(t), rel=2e-4)


def test_known_words_are_hashed_once(monkeypatch):
    rnd = random.Random(9)
    words = list({bytes(rnd.choices(b"abcde\x00\xc3\x1c", k=rnd.randint(1, 90))) for _ in range(3000)})
    counts = np.array([rnd.randint(1, 9) for _ in words])
    asked = rnd.choices(words, k=500) + [w + b"?" for w in words[:50]] + [b"a" * 200]
    want = [math.log10(n + 1) for n in (dict(zip(words[::2], counts[::2])).get(w, 0) for w in asked)]
    known = lm_scoring.Known(pa.array(words[::2], pa.binary()), counts[::2])
    with monkeypatch.context() as m:
        m.setattr(lm_scoring.pc, "index_in", None)  # it would hash all known words a call
        assert known.logs_of(pa.array(asked, pa.binary())).tolist() == pytest.approx(want)
        assert known.logs_of(pa.array([], pa.binary())).tolist() == []
    none = lm_scoring.Known(pa.array([], pa.binary()), np.zeros(0, np.int64))
    assert none.logs_of(pa.array(asked, pa.binary())).tolist() == [0.0] * len(asked)
    monkeypatch.setattr(lm_scoring.Known, "_hashes", staticmethod(lambda w: np.zeros(len(w), np.uint64)))
    alike = lm_scoring.Known(pa.array(words[::2], pa.binary()), counts[::2])
    assert alike.logs_of(pa.array(asked, pa.binary())).tolist() == pytest.approx(want)


def test_a_decision_needs_one_search(monkeypatch):
    rnd = random.Random(4)
    windows = np.unique(np.array([rnd.randrange(1 << 40) & 0x0303030303 for _ in range(500)], np.uint64))
    keys, counts = np.unique(np.concatenate([cm.contexts(windows[::2], k) for k in range(3)]), return_counts=True)
    searches, search = [], np.searchsorted
    monkeypatch.setattr(cm.np, "searchsorted", lambda a, *rest: searches.append(a is keys) or search(a, *rest))
    odds, gate = cm.Predictors(keys, counts)._look_up(windows)
    monkeypatch.undo()
    assert sum(searches) == 3 * 10
    seen = dict(zip(keys.tolist(), counts.tolist()))
    for k in range(3):
        for i, key in enumerate(cm.contexts(windows, k).tolist()):
            total = lambda shift: sum(seen.get((key >> shift << shift) + b, 0) for b in range(1 << shift))
            n = [total(shift) for shift in range(8, -1, -1)]
            assert odds[k][i].tolist() == pytest.approx([math.log((b + cm.DELTA) / (a - b + cm.DELTA)) for a, b in zip(n, n[1:])], rel=1e-6)
            assert k != cm.LONGEST or gate[i] == sum(n[0] >= s for s in (1, 3, 16))


def test_words_across_segments():
    raw = b"ab  cd\tef" * 50 + b"x" * 300 + b" y"
    assert b" ".join(segments(raw, 16)).split() == raw.split() and len(list(segments(raw, 16))) > 10
    texts = [b"", raw, b" \n ", b"one \xc3\xa9\x1ctwo ab", b"x" * 5, raw * 9000]
    got = defaultdict(list)
    for words, at, of in words_of(texts):
        for w, i in zip(np.array(words.to_pylist(), object)[at], of):
            got[i].append(w)
    assert [got[i] for i in range(len(texts))] == [re.split(rb"[ \t-\r]+", t.strip(b" \t\n\v\f\r")) if t.strip() else [] for t in texts]
