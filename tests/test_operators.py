"""Drill-down, connection ranges, search and paging against brute force."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ldaplens.functions.fields import parse_logs
from ldaplens.operators import pieces
from ldaplens.operators.drill import conn_ranges, drill, drill_keys, drill_linked, drill_text
from ldaplens.operators.paging import first_last, goto, goto_at, page, page_at, with_ordinal
from ldaplens.operators.pieces import substring_join
from ldaplens.operators.search import first_match_pos, search, search_many, search_numbered, search_span_rows, search_spans

LOG = [
    "conn=1 fd=3 ACCEPT from IP=1.2.3.4:5",
    "conn=1 op=0 BIND dn=\"uid=a,dc=x\" method=128",
    "conn=2 fd=4 ACCEPT from IP=1.2.3.5:6",
    "conn=1 op=1 SRCH base=\"dc=x\" scope=2 filter=\"(uid=a)\"",
    "conn=2 op=0 BIND dn=\"uid=b,dc=x\" method=128",
    "conn=1 op=1 SEARCH RESULT tag=101 err=0 nentries=1",
    "conn=2 op=1 SRCH base=\"dc=x\" scope=2 filter=\"(uid=b)\"",
    "conn=2 op=1 SEARCH RESULT tag=101 err=32 nentries=0",
    "conn=3 op=1 SRCH attr=cn uid",
    "conn=1 op=2 UNBIND",
]


def _logs(lines):
    return parse_logs(lines(LOG), fmt="rfc3339")


def _seed(spark, line_no, pos):
    return spark.createDataFrame([(1, "t.log", line_no, pos)], "seed_id long, file string, line_no long, pos int")


def test_conn_ranges_brute_force(lines):
    got = {(r.conn_id): (r.first_line, r.last_line, r.n_lines) for r in conn_ranges(_logs(lines)).collect()}
    want = defaultdict(list)
    for i, v in enumerate(LOG):
        want[v.split()[0][5:]].append(i)
    assert got == {k: (min(v), max(v), len(v)) for k, v in want.items()}


def test_drill_conn_and_dn(spark, lines):
    logs = _logs(lines)
    got = sorted(r.line_no for r in drill(logs, _seed(spark, 7, 2)).collect())  # conn=2 token
    assert got == [2, 4, 6, 7]
    got = sorted(r.line_no for r in drill(logs, _seed(spark, 1, 25)).collect())  # dn token -> conn 1
    assert got == [0, 1, 3, 5, 9]


def test_drill_op_err_base_noop(spark, lines):
    logs = _logs(lines)
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 3, 8)).collect()) == [3, 5]  # op=1 of conn 1
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 7, 37)).collect()) == [7]   # err=32
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 3, 20)).collect()) == [3, 6]  # base="dc=x"
    assert drill(logs, _seed(spark, 0, 8)).count() == 0  # fd=3: no drill


def test_drill_filter_and_attrs_are_substring(spark, lines):
    logs = _logs(lines)
    k = drill_keys(logs, _seed(spark, 3, 45))
    assert [r.key_value for r in k.collect()] == ["(uid=a)"]
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 3, 45)).collect()) == [3]
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 8, 22)).collect()) == [8]


def test_drill_text_of_many_needles(spark, lines):
    logs = _logs(lines)
    seeds = spark.createDataFrame([(i, "t.log", n, p) for i, (n, p) in enumerate([(3, 45), (6, 45), (8, 22)])],
                                  "seed_id long, file string, line_no long, pos int")
    keys = drill_keys(logs, seeds)
    got = sorted((r.key_value, r.line_no) for r in drill_text(logs, keys).collect())
    assert got == [("(uid=a)", 3), ("(uid=b)", 6), ("cn uid", 8)]


def test_substring_join_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("ab é", k=n))
    logs = [(f"f{i % 2}", i, text(rng.randint(0, 40)) if i % 9 else None) for i in range(200)]
    needles = [(f"f{i % 2}", text(rng.choice([0, 1, 2, 3, 7, 8, 9, 12]))) for i in range(120)] + [("f0", None)]
    got = sorted((r.line_no, r._needle) for r in substring_join(
        spark.createDataFrame(logs, "file string, line_no long, value string"),
        spark.createDataFrame(needles, "file string, _needle string"), "value").collect())
    assert got == sorted((i, n) for f, i, v in logs if v for g, n in {*needles} if f == g and n and n in v)
    none = spark.createDataFrame([], "file string, _needle string")
    assert substring_join(spark.createDataFrame(logs, "file string, line_no long, value string"), none, "value").count() == 0


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_substring_join_with_a_full_bitmap(spark, monkeypatch, step):
    monkeypatch.setattr(pieces, "LEAST_BITS", 64)
    monkeypatch.setattr(pieces, "MOST_BITS", 64)  # nearly every window passes: the joins must decide
    monkeypatch.setattr(pieces, "_STEP", step)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcé", k=n))
    logs = [("f", i, text(rng.randint(0, 30))) for i in range(60)]
    needles = [("f", text(rng.choice([1, 2, 8, 10]))) for _ in range(80)]
    got = sorted((r.line_no, r._needle) for r in substring_join(
        spark.createDataFrame(logs, "file string, line_no long, value string"), spark.createDataFrame(needles, "file string, _needle string"), "value").collect())
    assert got == sorted((i, n) for f, i, v in logs for _, n in {*needles} if n in v)


def test_substring_join_of_a_very_long_line(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh(=)", k=1_600_000))
    logs = spark.createDataFrame([("f", 0, long), ("f", 1, "short"), ("f", 2, long[:200_000])], "file string, line_no long, value string")
    needles = spark.createDataFrame([("f", long[1_500_000:1_500_030]), ("f", "short"), ("f", long[150_000:150_400]), ("f", "not there at all")], "file string, _needle string")
    join = lambda: sorted((r.line_no, len(r._needle)) for r in substring_join(logs, needles, "value").collect())
    assert join() == [(0, 30), (0, 400), (1, 5), (2, 400)]
    start = time.perf_counter()
    assert len(join()) == 4
    assert time.perf_counter() - start < 20  # walking from the line's start for each piece would take hours


def test_drill_op_of_a_line_without_connection(spark, lines):
    logs = parse_logs(lines(["op=5 a", "conn=1 op=5 b", "conn=2 op=5 c", "op=6"]), fmt="rfc3339")
    got = {r.key_conn for r in drill(logs, _seed(spark, 0, 1)).collect()}
    assert got == {None}
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 0, 1)).collect()) == [0, 1, 2]
    assert sorted(r.line_no for r in drill(logs, _seed(spark, 1, 8)).collect()) == [1]


def test_drill_reads_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    parse_logs(spark.createDataFrame([("t", i, v) for i, v in enumerate(LOG)], "file string, line_no long, value string"), fmt="rfc3339").write.parquet(path)
    logs = spark.read.parquet(path)
    keys, out = drill_linked(logs, spark.createDataFrame([(4, "t", 7, 2), (5, "t", 7, 37)], "seed_id long, file string, line_no long, pos int"),
                             kinds=["conn", "op", "thread", "err", "base"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("raw#") > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"Location: InMemoryFileIndex(1 paths)[file:{path}]") == 1 or plan.count("FileScan parquet") == 2
    assert sorted((r.seed_id, r.kind, r.key_value) for r in keys.collect()) == [(4, "conn", None), (5, "err", "32")]
    assert sorted((r.kind, r.line_no) for r in out.collect()) == [("conn", 2), ("conn", 4), ("conn", 6), ("conn", 7), ("err", 7)]


def test_ordinals_dense_across_buckets(spark):
    df = spark.range(0, 5000).select(F.lit("f").alias("file"), (F.col("id") * 3).alias("line_no"))
    got = [r.ord for r in with_ordinal(df, bucket=64).orderBy("line_no").collect()]
    assert got == list(range(5000))
    assert [r.ord for r in page(with_ordinal(df, bucket=64), 10, 3).orderBy("ord").collect()] == [10, 11, 12]
    assert goto(with_ordinal(df, bucket=64), 0).count() == 0
    assert goto(with_ordinal(df, bucket=64), 5001).count() == 0


def test_search_numbering_and_wrap(lines):
    vis = lines(["a x", "b", "x c", "d x x"])
    got = [tuple(r) for r in search_numbered(vis, "x").select(
        "line_no", "ord", "match_ord", "n_matches", "next_match_ord", "prev_match_ord", "next_line_no", "prev_line_no").orderBy("line_no").collect()]
    assert got == [(0, 0, 0, 3, 1, 2, 2, 3), (2, 2, 1, 3, 2, 0, 3, 0), (3, 3, 2, 3, 0, 1, 0, 2)]
    assert search(vis, "").count() == 0 and search_numbered(vis, "").count() == 0


def test_numbered_search_over_buckets(spark):
    rng = random.Random(6)
    rows = [(f"f{k}", i * 3, rng.choice(["hit", "miss"])) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, line_no long, value string").repartition(5)
    got = {(r.file, r.line_no): (r.ord, r.match_ord, r.n_matches, r.next_line_no, r.prev_line_no) for r in search_numbered(df, "hit", bucket=16).collect()}
    expected = {}
    for k in range(3):
        mine = [(n, v) for f, n, v in rows if f == f"f{k}"]
        hits = [n for n, v in mine if v == "hit"]
        for m, n in enumerate(hits):
            expected[f"f{k}", n] = (n // 3, m, len(hits), hits[(m + 1) % len(hits)], hits[m - 1])
    assert got == expected


def test_first_pos_and_spans_in_bytes(lines):
    df = lines(["aé x é", "eee"])
    r = df.select(first_match_pos("é").alias("p"), search_spans("é").alias("s")).collect()
    assert r[0].p == 1 and [(x.start_pos, x.end_pos) for x in r[0].s] == [(1, 3), (6, 8)]
    assert r[1].p is None
    assert [(x.start_pos, x.end_pos) for x in df.select(search_spans("ee").alias("s")).collect()[1].s] == [(0, 2)]


def test_first_last(lines):
    r = first_last(lines(["a", "b", "c"])).collect()[0]
    assert (r.first_line_no, r.first_value, r.last_line_no, r.last_value) == (0, "a", 2, "c")


def test_search_many_matches_single_searches(spark, lines):
    vis = lines(["a x", "b y", "x c y", "d"])
    qs = spark.createDataFrame([("t.log", "x"), ("t.log", "y"), ("t.log", "zz"), ("other", "d")], "file string, query string")
    got = sorted((r.query, r.line_no) for r in search_many(vis, qs).collect())
    assert got == [("x", 0), ("x", 2), ("y", 1), ("y", 2)]


def test_sized_tables_are_planned_by_their_size(spark):
    from ldaplens.operators.joins import sized

    small = sized(spark.range(100).selectExpr("id", "repeat('x', 10) AS s"))
    assert small.count() == 100
    plan = lambda df: spark.range(10**6).join(df, "id")._jdf.queryExecution().sparkPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert "BroadcastHashJoin" in plan(small)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        assert "SortMergeJoin" in plan(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_span_rows_equal_span_arrays(lines):
    df = lines(["aé x é", "eee", "none", "é" * 50])
    arrays = sorted((r.line_no, i, s.start_pos, s.end_pos)
                    for r in df.select("line_no", search_spans("é").alias("s")).collect() for i, s in enumerate(r.s))
    rows = sorted((r.line_no, r.span_idx, r.start_pos, r.end_pos) for r in search_span_rows(df, "é").collect())
    assert rows == arrays and len(rows) == 52


def test_pages_by_directory(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"f{i % 3}", rng.randrange(10_000), f"v{i}") for i in range(600)]
    df = spark.createDataFrame(sorted({(f, n): (f, n, v) for f, n, v in rows}.values()), "file string, line_no long, value string")
    whole = with_ordinal(df)
    for offset, height in ((0, 5), (37, 20), (150, 200), (195, 9), (9999, 5), (3, 0), (-1, 5)):
        for bucket in (1, 64, 1 << 16):
            got = sorted(map(tuple, page_at(df, offset, height, bucket=bucket).collect()))
            assert got == sorted(map(tuple, page(whole, offset, height).collect() if offset >= 0 else []))
    assert sorted(map(tuple, goto_at(df, 12).collect())) == sorted(map(tuple, goto(whole, 12).collect()))
    assert goto_at(df, 0).collect() == [] and goto_at(df.limit(0), 1).collect() == []


def test_a_page_reads_its_buckets_only(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    spark.range(50_000).selectExpr("'f' as file", "id as line_no", "'v' as value").write.parquet(str(tmp_path / "t"))
    found = page_at(spark.read.parquet(str(tmp_path / "t")), 30_000, 10, bucket=1024)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(line_no,29696)" in plan and "LessThan(line_no,30720)" in plan
    assert [r.ord for r in found.orderBy("ord").collect()] == list(range(30_000, 30_010))
