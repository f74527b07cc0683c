"""The kept line index: built, extended and merged; lines, slices and tails read through it."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ldaplens.sources import line_index as li
from ldaplens.sources.line_index import indexed_counts, lines_of, load_index, read_indexed, refresh_index, tail_indexed


@pytest.fixture()
def place(monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 64)
    d = tempfile.mkdtemp(prefix="ldaplens-index-")
    os.makedirs(f"{d}/logs")
    return d


def write(d, name, data, mode="wb"):
    with open(f"{d}/logs/{name}", mode) as f:
        f.write(data)


def model(d):
    out = {}
    for name in os.listdir(f"{d}/logs"):
        data = open(f"{d}/logs/{name}", "rb").read()
        parts = data.split(b"\n")
        parts = parts[:-1] if parts[-1] == b"" else parts
        pos = 0
        for i, p in enumerate(parts):
            out[name, i] = (pos, (p[:-1] if p.endswith(b"\r") else p).decode())
            pos += len(p) + 1
    return out


def got(df):
    return {(os.path.basename(r.file), r.line_no): (r.byte_pos, r.value) for r in df.collect()}


def test_build_extend_rewrite(spark, place):
    rnd = random.Random(1)
    text = lambda n: b"".join(bytes(rnd.choices(b"abc\xc3", k=0)) + b"l" * rnd.randint(0, 40) + rnd.choice([b"\n", b"\r\n", b"\n\n", "é\n".encode()]) for _ in range(n))
    write(place, "a.log", text(60) + b"open end")
    write(place, "b.log", b"")
    write(place, "c.log", b"x" * 500 + b"\n" + b"y" * 64)
    index = f"{place}/index"
    n = refresh_index(spark, f"{place}/logs", index)
    assert n == len(model(place)) and got(read_indexed(spark, index)) == model(place)
    assert refresh_index(spark, f"{place}/logs", index) == 0 and len(li._versions(index)) == 1
    first = load_index(spark, index).where("file like '%a.log'").count()
    before = len(model(place))
    write(place, "a.log", b" goes on\n" + text(20), "ab")
    write(place, "d.log", b"new\r\n")
    assert refresh_index(spark, f"{place}/logs", index) == len(model(place)) - before
    assert got(read_indexed(spark, index)) == model(place)
    added = spark.read.schema(li.ROWS).parquet(li._versions(index)[-1][2]).where("file like '%a.log'")
    assert added.agg(F.min("start")).first()[0] >= 64 * (first - 1)  # from the last block on
    write(place, "a.log", text(30))  # rewritten
    write(place, "c.log", b"z" + open(f"{place}/logs/c.log", "rb").read()[1:-1] + b"!" + b"more\n")  # changed at the end and longer
    refresh_index(spark, f"{place}/logs", index)
    assert got(read_indexed(spark, index)) == model(place)
    counts = {os.path.basename(r.file): r.n_lines for r in indexed_counts(spark, index).collect()}
    assert counts == {f: sum(k[0] == f for k in model(place)) for f in ("a.log", "c.log", "d.log")}


def test_many_refreshes_are_merged(spark, place, monkeypatch):
    monkeypatch.setattr(li, "MERGE_AFTER", 2)
    index = f"{place}/index"
    for i in range(6):
        write(place, "a.log", f"line {i} of the growing log, quite long\nand one more\npart".encode(), "ab")
        refresh_index(spark, f"{place}/logs", index)
        assert got(read_indexed(spark, index)) == model(place)
    assert len(li._versions(index)) <= 3
    assert any(full for number, full, _ in li._versions(index) if number)


def test_a_failed_version_is_not_seen(spark, place):
    index = f"{place}/index"
    write(place, "a.log", b"one\ntwo\n")
    refresh_index(spark, f"{place}/logs", index)
    write(place, "a.log", b"three\n", "ab")
    refresh_index(spark, f"{place}/logs", index)
    os.remove(f"{li._versions(index)[-1][2]}/_SUCCESS")
    assert set(got(read_indexed(spark, index))) == {("a.log", 0), ("a.log", 1)}
    assert refresh_index(spark, f"{place}/logs", index) == 1 and got(read_indexed(spark, index)) == model(place)


def test_slices_read_their_blocks_only(spark, place, monkeypatch):
    write(place, "a.log", b"".join(b"line %05d\n" % i for i in range(5000)))
    write(place, "b.log", b"only\n")
    index = f"{place}/index"
    refresh_index(spark, f"{place}/logs", index)
    part = read_indexed(spark, index).where("line_no >= 4000 and line_no < 4050")
    assert got(part) == {k: v for k, v in model(place).items() if 4000 <= k[1] < 4050}
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    file = next(r.file for r in indexed_counts(spark, index).collect() if r.file.endswith("a.log"))
    reader = li.LineReader({"index": index})
    list(reader.pushFilters([GreaterThanOrEqual(("line_no",), 4000), LessThan(("line_no",), 4050)]))
    assert sum(b[2] - b[1] for b in reader.blocks()) <= 50 * 11 + 2 * 64
    reader = li.LineReader({"index": index})
    list(reader.pushFilters([EqualTo(("line_no",), 7), In(("file",), (file, "none"))]))
    assert [b[1] for b in reader.blocks()] == [64]
    one = read_indexed(spark, index).where((F.col("file") == file) & (F.col("line_no") == 7))
    assert got(one) == {("a.log", 7): (77, "line 00007")}
    assert read_indexed(spark, index).where("line_no > 6000").collect() == []
    assert read_indexed(spark, index, files=[]).collect() == []


def test_texts_are_searched_in_bytes(spark, place):
    write(place, "a.log", "".join(f"conn={i % 7} é{i}\r\n" for i in range(3000)).encode())
    index = f"{place}/index"
    refresh_index(spark, f"{place}/logs", index)
    whole = model(place)
    for needle in ("conn=3 ", "é299", "none", ""):
        assert got(read_indexed(spark, index).where(F.col("value").contains(needle))) == {k: v for k, v in whole.items() if needle in v[1]}
    both = read_indexed(spark, index).where("contains(value, 'conn=3') and line_no between 100 and 400 and contains(value, 'é2')")
    assert got(both) == {k: v for k, v in whole.items() if 100 <= k[1] <= 400 and "conn=3" in v[1] and "é2" in v[1]}
    from pyspark.sql.datasource import StringContains

    reader = li.LineReader({"index": index})
    list(reader.pushFilters([StringContains(("value",), "conn=3")]))
    from contextlib import closing

    with closing(open(f"{place}/logs/a.log", "rb")) as f:
        assert sum(len(v) for p in reader.partitions() for r in p.runs for *_, v in lines_of(f, *r[1:4], r[4], needle=p.needle)) == 3000 // 7 + 1


def test_tails_have_numbers(spark, place):
    write(place, "a.log", b"".join(b"line %d\n" % i for i in range(100)) + b"open")
    write(place, "b.log", b"\n\n")
    write(place, "c.log", b"no end")
    write(place, "d.log", b"x" * 300 + b"\r\n" + b"y\n")
    index = f"{place}/index"
    refresh_index(spark, f"{place}/logs", index)
    tails = got(tail_indexed(spark, index, 3))
    assert tails == {k: v for k, v in model(place).items() if k in {("a.log", 97), ("a.log", 98), ("a.log", 99), ("b.log", 0), ("b.log", 1), ("d.log", 0), ("d.log", 1)}}


def test_compressed_files_are_refused_and_no_files(spark, place):
    import gzip

    write(place, "a.log", gzip.compress(b"hidden\n"))
    with pytest.raises(Exception, match="compressed"):
        refresh_index(spark, f"{place}/logs", f"{place}/index")
    assert read_indexed(spark, f"{place}/none").collect() == []


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_lines_of_any_cut(chunk, monkeypatch, tmp_path):
    monkeypatch.setattr(li, "_CHUNK", chunk)
    data = b"a\r\n\n\r\r\nlong line here\nx\r"
    p = tmp_path / "f"
    p.write_bytes(data)
    for size in range(1, len(data) + 1):
        out = []
        with open(p, "rb") as f:
            for start in range(0, len(data), size):
                before = data[:start - 1].count(b"\n") + 1 if start else 0
                for number, pos, value in lines_of(f, start, min(start + size, len(data)), before, len(data)):
                    out += zip(number.to_pylist(), pos.to_pylist(), value.to_pylist())
            for needle in (b"l", b"x", b"e h", b"absent"):
                some = [row for start in range(0, len(data), size) for c in lines_of(f, start, min(start + size, len(data)), data[:start - 1].count(b"\n") + 1 if start else 0,
                                                                                      len(data), needle=needle) for row in zip(*(x.to_pylist() for x in c))]
                assert some == [row for row in out if needle.decode() in row[2]]
        assert out == [(0, 0, "a"), (1, 3, ""), (2, 4, "\r"), (3, 7, "long line here"), (4, 22, "x")]
