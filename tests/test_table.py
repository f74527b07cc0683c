"""Compaction of a followed table: each line once at any time, few files, old ones kept for a while."""

import glob
import os
import shutil
import tempfile

import pytest

from ldaplens.functions.fields import parse_logs
from ldaplens.streaming import table as T
from ldaplens.streaming.follow import SCHEMA, follow_into_table


def _table():
    return tempfile.mkdtemp(prefix="ldaplens-table-") + "/t"


def _put(spark, table, batch, lines):
    rows = [("f.log", 0, 100 * batch + i, f"conn={batch} op={i}") for i in lines]
    parse_logs(spark.createDataFrame(rows, SCHEMA), fmt="rfc3339").write.mode("overwrite").parquet(f"{table}/batch_id={batch}")


def _places(spark, table):
    return sorted(r.byte_pos for r in T.read_table(spark, table).select("byte_pos").collect())


def test_lines_once_before_during_and_after(spark, monkeypatch):
    table = _table()
    assert _places(spark, table) == [] and T.compact(spark, table) == 0
    for b in range(5):
        _put(spark, table, b, range(3))
    want = [100 * b + i for b in range(5) for i in range(3)]
    assert _places(spark, table) == want
    held = T.read_table(spark, table)
    seen, publish = [], T._publish

    def switch(t, state):
        seen.append(_places(spark, t))  # the run is written, the switch is not made
        publish(t, state)
        seen.append(_places(spark, t))

    monkeypatch.setattr(T, "_publish", switch)
    assert T.compact(spark, table, at_least=6) == 0 and T.compact(spark, table, at_least=5) == 5
    assert seen == [want, want] and _places(spark, table) == want
    assert sorted(r.byte_pos for r in held.collect()) == want  # a reader of before
    _put(spark, table, 2, range(3))  # run again after a restart
    assert _places(spark, table) == want
    _put(spark, table, 5, range(2))
    assert _places(spark, table) == want + [500, 501]


def test_runs_grow_geometrically_and_old_files_go(spark):
    table = _table()
    for b in range(12):
        _put(spark, table, b, range(2))
        T.compact(spark, table, keep_seconds=0)
    state = T.manifest(table)
    assert len(state["runs"]) <= 5 and not state["retired"]
    assert not glob.glob(f"{table}/batch_id=*") and len(os.listdir(f"{table}/_runs")) == len(state["runs"])
    assert _places(spark, table) == [100 * b + i for b in range(12) for i in range(2)]


def test_a_dead_compaction_and_an_unfinished_batch(spark, monkeypatch):
    table = _table()
    _put(spark, table, 0, range(2))
    _put(spark, table, 1, range(2))
    os.remove(f"{table}/batch_id=1/_SUCCESS")
    publish = T._publish

    def die(*_):
        raise OSError("lost")

    monkeypatch.setattr(T, "_publish", die)
    with pytest.raises(OSError):
        T.compact(spark, table)
    monkeypatch.setattr(T, "_publish", publish)
    assert _places(spark, table) == [0, 1]
    assert T.compact(spark, table) == 1 and T.manifest(table)["through"] == 0
    _put(spark, table, 1, range(2))
    assert _places(spark, table) == [0, 1, 100, 101]
    monkeypatch.setattr(T, "DEAD_SECONDS", 0)
    T.clean(table, 0)
    assert len(os.listdir(f"{table}/_runs")) == 1 and _places(spark, table) == [0, 1, 100, 101]


def test_following_with_compaction(spark):
    d = os.path.dirname(_table())
    os.makedirs(f"{d}/logs")
    for i in range(5):
        with open(f"{d}/logs/s.log", "a") as f:
            f.write(f"conn={i} op=0 BIND\n")
        q = follow_into_table(spark, f"{d}/logs", f"{d}/t", f"{d}/ck", fmt="rfc3339", compact_after=2)
        q.processAllAvailable()
        q.stop()
    assert sorted(r.conn_id for r in T.read_table(spark, f"{d}/t").collect()) == list("01234")
    assert T.manifest(f"{d}/t")["through"] >= 3
    shutil.rmtree(d)
