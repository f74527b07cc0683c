"""Text and compressed scans, line numbers over several splits, tails, follow."""

import gzip
import lzma
import os
import tempfile
import bz2

from ldaplens.sources.codec import detect_codec, read_compressed
from ldaplens.sources.text import line_counts, read_logs, tail_lines


def _dir():
    return tempfile.mkdtemp(prefix="ldaplens-test-")


def test_crlf_blank_unterminated_and_empty(spark):
    d = _dir()
    open(f"{d}/a.log", "wb").write(b"one\r\n\r\ntwo\r\r\nthree")
    open(f"{d}/e.log", "wb").close()
    rows = sorted((os.path.basename(r.file), r.line_no, r.value) for r in read_logs(spark, d).collect())
    assert rows == [("a.log", 0, "one"), ("a.log", 1, ""), ("a.log", 2, "two\r"), ("a.log", 3, "three")]
    counts = {os.path.basename(r.file): r.n_lines for r in line_counts(spark, d).collect()}
    assert counts == {"a.log": 4, "e.log": 0}


def test_line_numbers_dense_over_many_splits(spark):
    d = _dir()
    with open(f"{d}/big.log", "w") as f:
        for i in range(20000):
            f.write(f"line {i} conn={i % 7}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = read_logs(spark, d)
        assert df.rdd.getNumPartitions() > 10
        got = [(r.line_no, r.value) for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f"line {i} conn={i % 7}") for i in range(20000)]


def test_split_size_may_change_after_definition(spark):
    d = _dir()
    with open(f"{d}/big.log", "w") as f:
        for i in range(20000):
            f.write(f"line {i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
        df = read_logs(spark, d)
        for size in (16 << 10, 1 << 20, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = sorted((r.line_no, r.value) for r in df.select("line_no", "value").collect())
            assert got == [(i, f"line {i}") for i in range(20000)], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_unnumbered_split_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from ldaplens.sources.text import with_line_no

    drawn = F.udf(lambda: int.from_bytes(os.urandom(4), "big"), "long").asNondeterministic()
    df = spark.range(10).select(F.lit("f").alias("file"), drawn().alias("_block"), F.col("id").alias("_mid"), F.lit("v").alias("value"))
    with pytest.raises(Exception, match="splits of f changed"):
        with_line_no(df).collect()  # the two passes draw different splits


def test_tail_skips_unterminated(spark):
    d = _dir()
    open(f"{d}/a.log", "w").write("".join(f"l{i}\n" for i in range(30)) + "partial")
    open(f"{d}/b.log", "wb").write(b"x\r\ny\n")
    open(f"{d}/c.log", "w").write("never ended")
    open(f"{d}/e.log", "w").close()
    open(f"{d}/z.log.gz", "wb").write(gzip.compress(b"".join(f"z{i}\n".encode() for i in range(30)) + b"rest"))
    got = sorted((os.path.basename(r.file), -r.back, r.byte_pos, r.value) for r in tail_lines(spark, d, 10).collect())
    assert [g[3] for g in got] == [f"l{i}" for i in range(20, 30)] + ["x", "y"] + [f"z{i}" for i in range(20, 30)]
    assert [g[2] for g in got if g[0] == "b.log"] == [0, 3]
    assert [g[1] for g in got if g[0] == "a.log"] == list(range(-10, 0))
    assert tail_lines(spark, d, 0).count() == 0


def test_one_scan_opens_any_file(spark):
    d = _dir()
    data = b"".join(f"conn={i} op=1\n".encode() for i in range(50))
    open(f"{d}/plain.log", "wb").write(data)
    open(f"{d}/named.log.gz", "wb").write(gzip.compress(data))
    open(f"{d}/plain.gz", "wb").write(data)
    open(f"{d}/hidden.log", "wb").write(bz2.compress(data))
    open(f"{d}/x.xz", "wb").write(lzma.compress(data))
    rows = read_logs(spark, d, codec="auto").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(os.path.basename(r.file), []).append((r.line_no, r.value))
    assert {k: sorted(v) for k, v in by_file.items()} == {
        n: [(i, f"conn={i} op=1") for i in range(50)] for n in ("plain.log", "named.log.gz", "plain.gz", "hidden.log", "x.xz")}


def test_ingest_reads_plain_files_in_splits(spark):
    from ldaplens.sources.codec import ingest_logs

    d = _dir()
    with open(f"{d}/big.log", "w") as f:
        for i in range(20000):
            f.write(f"conn={i % 7} op={i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        assert read_logs(spark, f"{d}/big.log", codec="auto").rdd.getNumPartitions() > 3
        t = ingest_logs(spark, f"{d}/big.log", f"{d}/out", fmt="rfc3339")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_no, r.op_id) for r in t.collect()) == [(i, str(i)) for i in range(20000)]


def test_codecs_by_content(spark):
    d = _dir()
    data = b"".join(f"conn={i} op=1\n".encode() for i in range(100))
    open(f"{d}/plain.log", "wb").write(data)
    open(f"{d}/g.log", "wb").write(gzip.compress(data[:500]) + gzip.compress(data[500:]))
    open(f"{d}/b.gz", "wb").write(bz2.compress(data[:300]) + bz2.compress(data[300:]))
    open(f"{d}/x.txt", "wb").write(lzma.compress(data[:100]) + lzma.compress(data[100:]))
    open(f"{d}/tiny", "wb").write(b"B")
    codecs = {os.path.basename(r.file): r.codec for r in detect_codec(spark, d).collect()}
    assert codecs == {"plain.log": "none", "g.log": "gzip", "b.gz": "bzip2", "x.txt": "xz", "tiny": "none"}
    rows = read_compressed(spark, d).collect()
    for name in ("plain.log", "g.log", "b.gz", "x.txt"):
        vals = [r.value for r in sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.line_no)]
        assert vals == [f"conn={i} op=1" for i in range(100)], name


def _follower(spark, d, path):
    from ldaplens.streaming.follow import follow_logs
    from ldaplens.streaming.stream import drain

    def run():
        drain(follow_logs(spark, path, checkpoint=f"{d}/ck").writeStream.format("parquet")
              .option("checkpointLocation", f"{d}/ck").start(f"{d}/sink"))

    def rows():
        return sorted((os.path.basename(r.file), r.generation, r.byte_pos, r.value) for r in spark.read.parquet(f"{d}/sink").collect())

    os.makedirs(f"{d}/logs")
    return run, rows


def test_follow_append_partial_and_truncate(spark):
    d = _dir()
    log = f"{d}/logs/s.log"
    run, rows = _follower(spark, d, f"{d}/logs")
    open(log, "w").write("".join(f"a{i}\n" for i in range(15)) + "par")
    run()
    open(log, "a").write("tial\nb1\n")
    run()
    open(log, "w").write("".join(f"c{i}\n" for i in range(30)))  # truncated and rewritten
    run()
    got = [(g, v) for _, g, _, v in rows()]
    assert got == ([(0, f"a{i}") for i in range(5, 15)] + [(0, "partial"), (0, "b1")] + [(1, f"c{i}") for i in range(30)])


def test_follow_rename_loses_and_repeats_nothing(spark):
    for whole in (True, False):  # the folder, or the one file
        d = _dir()
        log = f"{d}/logs/slapd.log"
        run, rows = _follower(spark, d, f"{d}/logs" if whole else log)
        open(log, "w").write("".join(f"a{i}\n" for i in range(100)))
        run()
        open(log, "a").write("".join(f"unread{i}\n" for i in range(5)))
        os.rename(log, log + ".1")
        open(log, "w").write("".join(f"n{i}\n" for i in range(1000)))
        run()
        open(log + ".1", "a").write("late\n")  # the writer had not reopened yet
        os.rename(log + ".1", log + ".2")
        os.rename(log, log + ".1")
        open(log, "w").write("third\n")
        run()
        run()
        got = rows()
        assert {r[0] for r in got} == {"slapd.log"}
        assert [v for _, g, _, v in got if g == 0] == [f"a{i}" for i in range(90, 100)] + [f"unread{i}" for i in range(5)] + ["late"]
        assert [v for _, g, _, v in got if g == 1] == [f"n{i}" for i in range(1000)]
        assert [v for _, g, _, v in got if g == 2] == ["third"]


def test_follow_copy_and_truncate(spark):
    d = _dir()
    log = f"{d}/logs/slapd.log"
    run, rows = _follower(spark, d, log)
    open(log, "w").write("".join(f"a{i}\n" for i in range(20)))
    run()
    open(log, "a").write("unread\n")
    open(log + ".1", "w").write(open(log).read())  # copied, then truncated in place
    open(log, "w").write("x\n")
    run()
    assert [(g, v) for _, g, _, v in rows()] == [(0, f"a{i}") for i in range(10, 20)] + [(0, "unread"), (1, "x")]


def test_follow_new_file_with_the_old_head(spark):
    d = _dir()
    log = f"{d}/logs/a.log"
    run, rows = _follower(spark, d, f"{d}/logs")
    open(log, "w").write("slapd starting\n")
    run()
    os.rename(log, f"{d}/away.log")
    open(log, "w").write("slapd starting\nnew 1\nnew 2\n")
    run()
    assert [(g, p, v) for _, g, p, v in rows()] == [(0, 0, "slapd starting"), (1, 0, "slapd starting"), (1, 15, "new 1"), (1, 21, "new 2")]


def test_follow_deleted_and_made_anew(spark):
    d = _dir()
    log = f"{d}/logs/a.log"
    run, rows = _follower(spark, d, f"{d}/logs")
    for n in range(3):  # a small file system gives the same inode again
        if n:
            os.remove(log)
        open(log, "w").write("banner\n" + "".join(f"{n}.{i}\n" for i in range(n)))
        run()
    assert [(g, v) for _, g, _, v in rows()] == [(0, "banner"), (1, "banner"), (1, "1.0"), (2, "banner"), (2, "2.0"), (2, "2.1")]


def test_follow_second_log_with_the_same_banner_is_no_copy(spark):
    d = _dir()
    run, rows = _follower(spark, d, f"{d}/logs")
    open(f"{d}/logs/a.log", "w").write("banner\n")
    run()
    os.remove(f"{d}/logs/a.log")
    open(f"{d}/logs/b.log", "w").write("banner\nb\n")
    run()
    assert [(f, g, v) for f, g, _, v in rows()] == [("a.log", 0, "banner"), ("b.log", 0, "banner"), ("b.log", 0, "b")]


def test_identity_chain(tmp_path, monkeypatch):
    from ldaplens.streaming import identity

    log, other = str(tmp_path / "s.log"), str(tmp_path / "t.log")
    block = identity.BLOCK
    data = os.urandom(9 * block + 77)
    open(log, "wb").write(data)
    chain = identity.extend({}, log, 0)
    for pos in (10, block, 3 * block + 5, 9 * block):
        chain = identity.extend(chain, log, pos)
    assert chain == identity.extend({}, log, 9 * block) and set(chain["blocks"]) == {"0", "1", "3", "7"}
    entry = {"name": log, "chain": chain, **identity.look(log)}
    assert identity.decide(entry, log, identity.look(log)) == identity.SAME
    for at, grown, expected in ((-1, b"more", identity.COPY), (0, b"", identity.NEW), (3 * block + 9, b"", identity.NEW), (9 * block - 1, b"", identity.NEW),
                                (9 * block + 1, b"", identity.COPY)):
        copy = bytearray(data)
        if at >= 0:
            copy[at] ^= 1
        open(other, "wb").write(bytes(copy) + grown)
        assert identity.decide(entry, other, identity.look(other)) == expected
    open(other, "wb").write(data[:8 * block])
    assert identity.decide(entry, other, identity.look(other)) == identity.NEW  # shorter than what was read
    os.truncate(log, block)
    assert identity.decide(entry, log, identity.look(log)) == identity.NEW
    # an untouched file is not opened
    entry.update(identity.look(log))
    monkeypatch.setattr(identity, "_digest", lambda *a: 1 / 0)
    assert identity.decide(entry, log, identity.look(log)) == identity.SAME


def test_follow_file_first_seen_empty(spark):
    d = _dir()
    log = f"{d}/logs/s.log"
    run, rows = _follower(spark, d, log)
    open(log, "w").close()
    run()
    open(log, "w").write("one\ntwo\n")
    run()
    open(log, "w").write("uno\ndos\ntres\n")  # longer than what was read, other content
    run()
    assert [(g, v) for _, g, _, v in rows()] == [(0, "one"), (0, "two"), (1, "uno"), (1, "dos"), (1, "tres")]


def test_follow_refuses_other_stores(spark):
    import pytest

    from ldaplens.streaming.follow import follow_logs

    with pytest.raises(ValueError, match="mounted"):
        follow_logs(spark, "s3://bucket/logs")


def test_follow_into_table_counts_new_lines(spark):
    from ldaplens.streaming.follow import follow_into_table, new_line_count

    d = _dir()
    os.makedirs(f"{d}/logs")
    open(f"{d}/logs/s.log", "w").write("conn=1 op=0 BIND\nconn=1 op=1 SRCH\n")
    q = follow_into_table(spark, f"{d}/logs", f"{d}/table", f"{d}/ck", fmt="rfc3339")
    q.processAllAvailable()
    assert new_line_count(q) == 2
    open(f"{d}/logs/s.log", "a").write("conn=2 op=0 BIND\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.conn_id for r in spark.read.parquet(f"{d}/table").collect()) == ["1", "1", "2"]


def test_tail_of_long_lines(spark):
    d = _dir()
    with open(f"{d}/big.log", "w") as f:
        for i in range(2000):
            f.write(f"line {i} " + "x" * (i * 37 % 9000) + "\n")
        f.write("unterminated")
    got = sorted((r.byte_pos, r.value.split(" x")[0]) for r in tail_lines(spark, d, 30).collect())
    assert [v.strip() for _, v in got] == [f"line {i}" for i in range(1970, 2000)]
