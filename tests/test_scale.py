"""Costs that may not outgrow the input: batches, tasks, regex walks, compiled code."""

from ldaplens.functions.tokens import explode_tokens, with_tokens
from ldaplens.session import ensure_utc
from ldaplens.sources.text import read_logs, small_splits
from ldaplens.streaming.stream import drain, run_to_parquet, stream_lines


def test_many_waiting_files_take_few_batches(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(30):
        (logs / f"f{i:02}.log").write_text(f"line {i}\nlast {i}\n")
    sink = str(tmp_path / "sink")
    query = run_to_parquet(stream_lines(spark, str(logs), 2, max_batches=5), sink, str(tmp_path / "ckpt"))
    drain(query)
    assert 1 < len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) <= 5
    assert sorted(r["value"] for r in spark.read.parquet(sink).collect()) == sorted(f"{w} {i}" for i in range(30) for w in ("line", "last"))


def test_small_splits_share_tasks(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"s{n}.log").write_text("".join(f"{n} line {i} of the file\n" for i in range(40_000)))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    logs = read_logs(spark, str(tmp_path))
    with small_splits(spark, str(tmp_path), 4096):
        raw = spark.read.text(str(tmp_path))
        splits = raw.selectExpr("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert splits > 600 and raw.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 8
        got = {(r["line_no"], r["value"]) for r in logs.collect()}
    assert [spark.conf.get(k, None) for k in keys] == before
    assert got == {(i, f"{n} line {i} of the file") for n in range(3) for i in range(40_000)}


def test_tokens_are_walked_once_for_their_rows(spark, lines):
    p = with_tokens(lines(['2024-01-15T10:30:00.123Z 0x7f0000000001 conn=1 op=2 SRCH base="x" attr=cn uid', "", None]), "value", keywords=False)
    walks = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    rows = explode_tokens(p)
    assert walks(rows) == walks(p.select("file", "line_no", "tokens"))
    assert [(r["token_idx"], r["type"]) for r in rows.orderBy("line_no", "token_idx").collect()] == list(enumerate(
        ["TIMESTAMP", "THREAD_ID", "CONN_ID", "OP_ID", "KEYWORD", "BASE", "ATTR", "ATTR_LIST"]))


def test_types_without_their_anchor_are_not_walked(spark, lines):
    p = with_tokens(lines(["é 2024-01-15T10:30:00.1Z then 2024-01-15T10:30:00.2Z x", None]), "value", keywords=False)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(value" in plan and a in plan for a in ('dn="', 'filter="', 'base="', "SEARCH RESULT", "attr=", "0x"))
    first, null = p.orderBy("line_no").collect()
    assert [tuple(t) for t in first["tokens"]] == [(3, 25, "TIMESTAMP", "2024-01-15T10:30:00.1Z")] and null["tokens"] is None


def test_generated_methods_stay_within_what_the_jvm_compiles(spark):
    ensure_utc(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
