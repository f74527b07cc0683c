"""Connection aggregates (A1-A4) and drill-down joins.

A viewer drills from one clicked token at one cursor. Here ``seeds`` is a
table ``(seed_id, file, line_no, pos)``: any number of clicks at once. Each
seed resolves to a *drill key* ``(file, kind, key_conn, key_value)``; the
keys are de-duplicated before they meet the log, so the result has one row
per (matching line, key) -- never one per (line, seed), which would multiply
a hot connection by its seed count.

Key -> lines is one equi-join for conn / op / thread / err / base (D1-D6): each
line gives the keys it answers to. Filter bodies and attribute lists (D7, D8)
are a substring join by a filter of pieces (see ``pieces``). The key side is
written first, so the planner broadcasts it by its true size; above the limit
the join is a shuffle join, where AQE splits a hot key (one connection may hold
a third of a file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldaplens.functions.tokens import token_at, with_tokens
from ldaplens.operators.filters import FilterStack
from ldaplens.operators.joins import sized
from ldaplens.operators.pieces import substring_join

KEY_SCHEMA = "file string, kind string, key_conn string, key_value string"


# ---------------------------------------------------------------- aggregates
def conn_ranges(logs: DataFrame) -> DataFrame:
    """A1: first line, last line and line count of every connection of every file.

    A partial + final hash aggregate: map-side combine keeps a hot connection
    to one row per task before the shuffle. A reused id (server restart) merges,
    as in the viewer.
    """
    return (
        logs.where(F.col("conn_id").isNotNull())
        .groupBy("file", "conn_id")
        .agg(
            F.min("line_no").alias("first_line"),
            F.max("line_no").alias("last_line"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


def conn_lines(logs: DataFrame, conn_id: str, file: str | None = None) -> DataFrame:
    """A2: the lines of one connection (sort by ``file, line_no`` to read in order)."""
    p = F.col("conn_id") == F.lit(conn_id)
    if file is not None:
        p = p & (F.col("file") == F.lit(file))
    return logs.where(p)


def visible_counts(logs: DataFrame, stack: FilterStack) -> DataFrame:
    """A3: ``(file, visible, total)`` -- lines passing the stack and all lines."""
    return logs.groupBy("file").agg(
        F.count_if(stack.predicate()).alias("visible"),
        F.count(F.lit(1)).alias("total"),
    )


# ------------------------------------------------------------- seed -> keys
def _body(value: Column, prefix: str) -> Column:
    """Quoted body of a ``key="body"`` token value."""
    return F.regexp_extract(value, "^" + prefix + '="([^"]*)"', 1)


def key_of_token(tok: Column, line_conn: Column) -> tuple[Column, Column, Column]:
    """Map the clicked token to ``(kind, key_conn, key_value)``; kind NULL = no-op."""
    t = tok["type"]
    v = tok["value"]
    base_body = _body(v, "base")
    filter_body = _body(v, "filter")
    kind = (
        F.when(t == "CONN_ID", "conn")
        .when((t == "DN_VALUE") & line_conn.isNotNull(), "conn")  # D2: the line's connection
        .when(t == "OP_ID", "op")
        .when(t == "THREAD_ID", "thread")
        .when(t == "ERROR_CODE", "err")
        .when((t == "BASE") & (base_body != ""), "base")
        .when((t == "FILTER_VALUE") & (filter_body != ""), "text")
        .when(t == "ATTR_LIST", "text")
    )
    key_conn = (
        F.when(t == "CONN_ID", F.substring(v, 6, 1 << 30))
        .when(t.isin("DN_VALUE", "OP_ID"), line_conn)
    )
    key_value = (
        F.when(t == "OP_ID", F.substring(v, 4, 1 << 30))
        .when(t == "THREAD_ID", v)
        .when(t == "ERROR_CODE", F.substring(v, 5, 1 << 30))
        .when(t == "BASE", base_body)
        .when(t == "FILTER_VALUE", filter_body)
        .when(t == "ATTR_LIST", v)
    )
    return kind, key_conn, key_value


def drill_keys(logs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed_id, file, line_no, token_type, kind, key_conn, key_value)`` per seed.

    Tokens are computed only for the seed lines. Seeds picked from the parsed
    log itself can carry its ``raw`` and ``conn_id`` columns: then no join is
    needed at all (a large seed set -- every failed result of a 100 TB log --
    never re-shuffles the log). Otherwise the seeds are joined to the log on
    ``(file, line_no)``, which is unique, so that join has no hot key.
    """
    if {"raw", "conn_id"} <= set(seeds.columns):
        lines = seeds.select("seed_id", "file", "line_no", "pos", "raw", "conn_id")
    else:
        seed_side = sized(seeds.select("seed_id", "file", "line_no", "pos"), "seeds")
        lines = logs.select("file", "line_no", "raw", "conn_id").join(seed_side, ["file", "line_no"])
    lines = with_tokens(lines, keywords=False)
    tok = token_at(F.col("tokens"), F.col("pos"))
    with_tok = lines.select("seed_id", "file", "line_no", "conn_id", tok.alias("tok"))
    kind, key_conn, key_value = key_of_token(F.col("tok"), F.col("conn_id"))
    keys = with_tok.select(
        "seed_id", "file", "line_no",
        F.col("tok.type").alias("token_type"),
        kind.alias("kind"), key_conn.alias("key_conn"), key_value.alias("key_value"),
    )
    return sized(keys, "seed-keys")


# ------------------------------------------------------------- keys -> lines
EQUAL_KINDS = ("conn", "op", "thread", "err", "base")
KINDS = (*EQUAL_KINDS, "text")


def _line_keys(kinds) -> Column:
    """The keys a line answers to, as structs: D1/D2 its connection, D3 the operation
    within the connection and by itself, D4-D6 thread, result code and base."""
    none = F.lit(None).cast("string")
    keys = {
        "conn": [(F.col("conn_id"), none, "conn_id")],
        "op": [(F.col("conn_id"), F.col("op_id"), "op_id"), (none, F.col("op_id"), "op_id")],
        "thread": [(none, F.col("thread_id"), "thread_id")],
        "err": [(none, F.col("error_code"), "error_code")],
        "base": [(none, F.col("base"), "base")],
    }
    structs = []
    for kind in kinds:
        for i, (conn, value, needs) in enumerate(keys[kind]):
            there = F.col(needs).isNotNull() & (F.col("conn_id").isNotNull() if kind == "op" and i == 0 else F.lit(True))
            structs.append(F.when(there, F.struct(F.lit(kind).alias("kind"), conn.alias("key_conn"), value.alias("key_value"))))
    return F.array_compact(F.array(*structs))


def drill_equal(logs: DataFrame, keys: DataFrame, kinds=EQUAL_KINDS) -> DataFrame:
    """One read of the log and one equi-join for all ``kinds``. The result is tagged with
    the key; a line that answers to several keys comes once for each."""
    wanted = keys.where(F.col("kind").isin(*kinds)).select(
        F.col("file").alias("_file"), F.col("kind").alias("_kind"), F.col("key_conn").alias("_conn"),
        F.col("key_value").alias("_value")).distinct()
    wanted = sized(wanted)
    each = logs.withColumn("_key", F.explode(_line_keys(kinds)))
    same = ((F.col("file") == F.col("_file")) & (F.col("_key.kind") == F.col("_kind"))
            & F.col("_key.key_conn").eqNullSafe(F.col("_conn")) & F.col("_key.key_value").eqNullSafe(F.col("_value")))
    return each.join(wanted, same).select("_key.kind", "_key.key_conn", "_key.key_value", *logs.columns)


def drill_conn(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """Every line of each keyed connection (its range is implied)."""
    return drill_equal(logs, keys, ["conn"])


def drill_op(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """D3: the connection of the seed line (when it has one) AND the operation."""
    return drill_equal(logs, keys, ["op"])


def drill_thread(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """D4."""
    return drill_equal(logs, keys, ["thread"])


def drill_err(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """The result code across the file, no connection."""
    return drill_equal(logs, keys, ["err"])


def drill_base(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """The search base (empty bases were dropped as no-ops)."""
    return drill_equal(logs, keys, ["base"])


def drill_text(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines of the seed's file whose normalised text contains the needle."""
    needles = keys.where(F.col("kind") == "text").select("file", F.col("key_value").alias("_needle"))
    found = substring_join(logs, needles, "raw")
    return found.select(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("key_conn"),
                        F.col("_needle").alias("key_value"), *logs.columns)


def drill(logs: DataFrame, seeds: DataFrame, kinds=None, stack: FilterStack | None = None) -> DataFrame:
    """Resolve every seed to its drill key and return the matching lines.

    ``stack`` (D10) is applied to the log first, so new keys AND onto the
    existing filters. Seeds on tokens without a drill (D9) contribute nothing.
    Result: ``(kind, key_conn, key_value, <log columns>)``; ``drill_linked`` also
    tells which seeds each key comes from.
    """
    return drill_linked(logs, seeds, kinds, stack)[1]


def drill_linked(logs: DataFrame, seeds: DataFrame, kinds=None,
                 stack: FilterStack | None = None) -> tuple[DataFrame, DataFrame]:
    """``(keys, lines)``: ``drill_keys`` of the seeds (``seed_id`` -> key) beside the lines of ``drill``.

    The two share ``(file, kind, key_conn, key_value)``; kept apart, a hot connection
    is not multiplied by its seeds. The log is read once for all kinds of D1-D6
    and once for D7/D8.
    """
    keys = drill_keys(logs, seeds)
    target = logs if stack is None or stack.empty else logs.where(stack.predicate())
    kinds = list(KINDS) if kinds is None else list(kinds)
    parts = [drill_equal(target, keys, equal)] if (equal := [k for k in kinds if k in EQUAL_KINDS]) else []
    if "text" in kinds:
        parts.append(drill_text(target, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return keys, out


def undo(stack: FilterStack, whole: bool = False) -> FilterStack:
    """Drop the last filter (default) or clear the whole stack."""
    return stack.clear() if whole else stack.pop()
