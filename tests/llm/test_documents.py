import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import ldaplens.llm.exact_dedup as exact
from ldaplens.llm.exact_dedup import Directory, exact_dedup, insert, keep_one, new_index
from ldaplens.llm.quality import keep_good, quality_rules, sketch, thresholds
from ldaplens.llm.secret_scans import RULES, digest, findings, join_back, read_ledger, record, redact, scan_new, scan_secrets
from ldaplens.llm.suffix_dedup import remove_repeats, segments

# the rules' base patterns, in words of their own
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
BASE = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
SECRETS = [
    "password = hunter22 and PassWd:'abc' and secret=token:abcdefg", "token==abcde token = x", "é 😀 api_key: \"A1b2C3d4\" apikey=zzzzzz",
    "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15 + " xAKIAAKIA" + "9" * 20, "hex " + "0a" * 12 + " " + "f" * 23 + " " + "e" * 500, "secret=" + "ab12" * 6 + "0123", "token=" * 300 + "abcdef",
    " ".join(f"token={i:06d}" for i in range(400)),
]


def spans(t):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t) if ok(m))


@pytest.fixture()
def secrets(spark, odd):
    rows = spark.createDataFrame([(100 + i, t, "en", "s0", 1, 1, "k", 2) for i, t in enumerate(SECRETS + SECRETS[:3])], odd.schema)
    return odd.union(rows)


def test_secret_spans(secrets):
    got = digest(scan_secrets(secrets)[0]).collect()
    expected = []
    for r in secrets.collect():
        found = spans(r["text"] or "")
        text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in found)
        n = Counter(k for _, k, _ in found)
        expected.append((r["doc_id"], n[0], n[1], n[2], sha256(text.encode()).hexdigest(), text))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_ledger_scans_unseen_pairs_only(secrets):
    _, ledger = scan_secrets(secrets)
    texts = secrets.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert scan_new(texts, ledger).count() == 0
    newer = {**RULES, "hex": ("hex/2", r"([0-9a-f]{30,})", 30)}
    again = scan_new(texts, ledger, newer).collect()
    assert {tuple(r["versions"]) for r in again} == {("hex/2",)} and len(again) == texts.select("text").distinct().count()
    assert all(m["rank"] == 2 for r in again for m in r["matches"])
    more = texts.union(texts.limit(1).select(F.lit(999), F.lit("token=brandnew1")))
    paths, whole = scan_secrets(more, ledger)
    assert whole.count() == ledger.count() + 1
    assert {r["doc_id"]: len(r["found"]) for r in paths.collect()}[999] == 1
    assert findings(ledger.limit(0)).count() == 0


def test_ledger_in_its_place(spark, secrets, tmp_path):
    """Batches, restarts, two recorders at a time and new rule versions leave one finding each."""
    place, want = f"file:{tmp_path}/ledger", sorted(map(tuple, digest(scan_secrets(secrets)[0]).collect()), key=str)
    assert read_ledger(spark, place).count() == 0
    half = secrets.where("doc_id % 2 = 0")
    first = record(half, place).count()
    whole = record(secrets, place)
    n = secrets.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert 0 < first < n and whole.count() == n == record(secrets, place).count()
    assert sorted(map(tuple, digest(join_back(secrets, read_ledger(spark, place))).collect()), key=str) == want
    newer = {**RULES, "hex": ("hex/2", r"([0-9a-f]{24,})", 24)}
    both = record(secrets, place, newer)
    assert both.count() == 2 * n
    assert sorted(map(tuple, digest(join_back(secrets, both.union(both), newer)).collect()), key=str) == want
    assert sorted(map(tuple, digest(join_back(secrets, both)).collect()), key=str) == want
    (tmp_path / "ledger" / "part-dead").mkdir()
    assert read_ledger(spark, place).count() == 2 * n and record(secrets.limit(0), place).count() == 2 * n


def test_redaction(secrets):
    got = redact(secrets)
    assert got.schema == secrets.schema or got.columns == secrets.columns
    expected = []
    for r in secrets.collect():
        t, out, at = r["text"], "", 0
        for s, _, e in spans(t or ""):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        expected.append((r["doc_id"], None if t is None else out + t[at:], r["source"], r["key"]))
    assert sorted((tuple(r[c] for c in ("doc_id", "text", "source", "key")) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert redact(secrets.limit(0)).count() == 0


def counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(words)
    seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts(odd):
    got = quality_rules(odd)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(((r["doc_id"], *counts(r["text"] or "")) for r in odd.collect()), key=str)
    assert not [r for r in got.collect() if r["kept"] and r["base_failed"]]
    assert quality_rules(odd.limit(0)).count() == 0


def test_quality_thresholds_follow_the_source(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows = []
    for i in range(900):  # prose, a source whose normal texts are full of symbols, and junk in the first
        source = ("news", "code")[i % 2]
        mark = "#" if source == "code" else ""
        junk = i % 10 == 0
        rows.append((i, " ".join(word() + mark + ("$$$" if junk else "") for _ in range(60)), "en", source, junk))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    kept = keep_good(df)
    assert kept.columns == df.columns
    got = {r["doc_id"] for r in kept.collect()}
    assert got == {r[0] for r in rows if not r[4]}


def test_sketches_merge_and_bound_quantiles(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 5) if rng.random() < 0.5 else rng.randint(0, 100_000) for _ in range(4000)]
    cols = ["__symbols", "__dup_lines", "__repeats", "__capitals"]
    rows = [("en", f"s{i % 3}", 20, v, v, v, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "__lang string, __source string, n_words long, " + ", ".join(f"{c} long" for c in cols))
    group = ["__lang", "__source"]
    whole = sketch(df, group)
    parts = sketch(df.where("__symbols % 2 = 0"), group).union(sketch(df.where("__symbols % 2 = 1"), group))
    merged = parts.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    for r in thresholds(whole).collect():
        own = sorted(v for i, v in enumerate(values) if f"s{i % 3}" == r["__source"])
        q = lambda p: own[-(-p * len(own) // 100) - 1]
        low, high = q(50), q(50) * 9 // 8 + 1
        assert low + 4 * (low - q(10) * 9 // 8 - 1) <= r["t_symbols"] <= high + max(150, 4 * (high - q(10)))


def groups_of(rows):
    best, size = {}, Counter()
    for i, t in rows:
        t = t or ""
        size[t] += 1
        best[t] = i if best.get(t) is None else best[t] if i is None else max(best[t], i)
    return best, size


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(5).cast("long")])
def test_exact_dedup(odd, key):
    got = exact_dedup(odd, key=key, capacity=2, range_bytes=1000).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    best, size = groups_of(rows)
    expected = sorted(((i, best[t or ""], size[t or ""], sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(best)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_keep_one(odd):
    got = keep_one(odd)
    best, _ = groups_of([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(((i, t) for t, i in best.items()), key=str)
    assert keep_one(odd.limit(0)).count() == 0 and exact_dedup(odd.limit(0)).count() == 0


def test_index_takes_batches(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = make([(i, f"text {i % 40}") for i in range(200)])
    index = new_index(first, capacity=3)
    one, index = insert(first, index)
    assert {(r["text"], r["keep_id"], r["group_size"]) for r in one.collect()} == {(f"text {i}", 160 + i, 5) for i in range(40)}
    two, index = insert(make([(7, "text 7"), (900, "text 8"), (901, "fresh")]), index)
    assert {(r["text"], r["keep_id"], r["group_size"]) for r in two.collect()} == {("text 8", 900, 6), ("fresh", 901, 1)}
    assert index["version"] == 2


def test_directory_splits_and_doubles(tmp_path):
    d = Directory(capacity=2)
    keys = [0b0001, 0b0101, 0b1001, 0b1101, 0b0010, 0b0000, 0b0001]
    for n, k in enumerate(keys):
        d.put(k, f"t{n}", n, 1, None)
    assert d.depth == 3 and len(d.slots) == 8
    assert all(len(b[1]) <= 2 for b in d.buckets())
    assert [e[0] for e in d.chain(0b0001)] == ["t0", "t6"]
    d.save(f"{tmp_path}/x/one.parquet")
    again = Directory.load(f"file://{tmp_path}/x/one.parquet", 2)
    entries = lambda x: sorted((k, e[0], e[1], e[2]) for b in x.buckets() for k, c in b[1].items() for e in c)
    assert entries(again) == entries(d) and again.depth == d.depth


def removed(rows, length):
    """Brute force over every window in order of id and place."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen.setdefault(data[p : p + length], (i, p)) != (i, p):
                mark[p : p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(data, mark) if not m)
        out[i] = (len(data), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), kept)
    return out


@pytest.mark.parametrize("length,batches", [(100, 4), (100, 1), (24, 5), (9, 3)])
def test_suffix_dedup(spark, length, batches):
    rng = random.Random(length)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = [None, "", "x" * 3000, "x" * 250, "xy" * 400, "short"]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.5:
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            t += s[a:b] + word()
        if rng.random() < 0.2 and texts[-1]:
            t = texts[-1] if rng.random() < 0.5 else texts[-1][:-30] + t
        texts.append(t)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, first int, runs string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df, length, batches=batches).collect()}
    assert got == removed(rows, length)


@pytest.mark.parametrize("rows_at_a_time", [2, 3, 7])
def test_suffix_dedup_across_arrow_batches(spark, monkeypatch, rows_at_a_time):
    from ldaplens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SCAN_ROWS", rows_at_a_time)
    rng = random.Random(rows_at_a_time)
    passages = ["".join(rng.choices("abcdefgh ", k=rng.randint(30, 60))) for _ in range(12)]
    rows = [(i, "".join(f"{rng.random()}"[: rng.randint(0, 12)] + p for p in rng.sample(passages, 3))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df, 24).collect()}
    assert got == removed(rows, 24)


def test_scan_tells_entries_held_at_a_batch_boundary(spark, monkeypatch):
    from ldaplens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SCAN_ROWS", 2)
    # gram 2 goes on in the second batch with a repeat only, then other grams come
    entries = [(1, 1, 4, 0), (2, 2, 5, 0), (2, 2, 7, 0), (3, 3, 2, 0), (3, 4, 3, 0), (5, 5, 6, 0)]
    df = spark.createDataFrame(entries, suffix_dedup.ROWS).coalesce(1)
    monkeypatch.setattr(type(df), "repartition", lambda self, *_: self)  # all grams in one task
    got = sorted(map(tuple, suffix_dedup._scan(df, None, True).collect()))
    new, edge = suffix_dedup.NEW, suffix_dedup.NEW | suffix_dedup.EDGE
    assert got == sorted([(new, 1, 1, 4, 0), (new, 2, 2, 5, 0), (suffix_dedup.REPEAT, 2, 2, 7, 0), (edge, 3, 3, 2, 0), (edge, 3, 4, 3, 0), (new, 5, 5, 6, 0)])


def test_suffix_dedup_of_a_large_group(spark, monkeypatch):
    from ldaplens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "GROUP", 5)
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=180))
    rows = [(i, f"{rng.random()}" * rng.randint(1, 3) + passage + f"{rng.random()}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df).collect()}
    assert got == removed(rows, 100)


def test_large_groups_give_runs_and_no_single_windows(spark, monkeypatch):
    from ldaplens.llm import suffix_dedup

    rng = random.Random(10)
    passage = bytes(rng.choices(b"abcdefgh ", k=110))
    content = [(i % 3, i // 2, 10 * (i % 2), bytes(rng.choices(b"ab", k=i % 2)) + passage[: rng.randint(100, 110)] + bytes(rng.choices(b"ab", k=5))) for i in range(120)]
    df = spark.createDataFrame(content, "gram long, doc_id long, first int, content binary")
    found = []
    for group in (8192, 5):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        found.append(sorted(map(tuple, suffix_dedup._windows(df, 100).collect())))
    assert found[0] == found[1] and len(found[0][0]) == 3
    assert len(found[1]) < 2 * len(content) < sum(last - first + 1 for _, first, last in found[1])


def test_suffix_dedup_without_ids(spark):
    df = spark.createDataFrame([(None, "a" * 300), (None, None), (1, "b" * 300), (1, "b" * 300)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(df).collect()), key=str)
    assert got == sorted([(None, 300, 0), (None, 0, 0), (1, 300, 299), (1, 300, 299)], key=str)
    assert remove_repeats(df.limit(0)).count() == 0


def test_segments_cover_all_windows_by_content():
    rng = random.Random(8)
    data = bytes(rng.choices(b"abc", k=5000))
    for length in (9, 40, 100):
        _, first, last = segments(data, length)
        assert first[0] == 0 and last[-1] == len(data) - length and (first[1:] == last[:-1] + 1).all()
        gram, f2, l2 = segments(data[700:1700], length)
        inner = {(a + 700, b + 700) for a, b in zip(f2[1:-1].tolist(), l2[1:-1].tolist())}
        assert inner <= set(zip(first.tolist(), last.tolist()))


def test_a_third_of_all_rows_equal(spark, monkeypatch):
    """One text over many Arrow batches of a task and of its owner; room for held texts or none."""
    rows = [(i, "the same text" if i % 3 == 0 else f"pair {i % 400}" if i % 3 == 1 else f"text {i}", f"x{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    last, size = {}, {}
    for i, t, _ in rows:
        last[t], size[t] = max(i, last.get(t, -1)), size.get(t, 0) + 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for room, slack in ((0, 1), (60, 1), (1 << 20, 1000)):
        monkeypatch.setattr(exact, "HOT_BYTES", room)
        monkeypatch.setattr(exact, "SLACK", slack)
        monkeypatch.setattr(exact.common, "python_ready", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50"))
        got = insert(docs, new_index(docs, capacity=4, range_bytes=1 << 30))[0].collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted((r["text"], r["keep_id"], r["group_size"], r["row"]["doc_id"], r["row"]["source"]) for r in got) == sorted(
            (t, i, size[t], i, f"x{i}") for t, i in last.items())
