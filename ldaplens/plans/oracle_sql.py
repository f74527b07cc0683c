"""DuckDB statements, one per registered query (same names, same output columns)."""

from __future__ import annotations

from ldaplens.plans import oracle as O
from ldaplens.plans.queries import BASE, CONN, DN, DOC_QUERY, ERR, OP, SPAN_QUERY, TEXT, THREAD

P = O.parsed("mixed", "auto")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ts_us(col: str = "ts_text") -> str:
    frac = f"rpad(substr(regexp_extract({col}, '\\.(\\d+)Z$', 1), 1, 6), 6, '0')"
    return f"epoch_us(strptime(substr({col}, 1, 20) || {frac}, '%Y-%m-%dT%H:%M:%S.%f'))"


def _sorted_tokens(src: str) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY file, line_no ORDER BY start_pos, end_pos, type, value) AS rn "
            f"FROM {O.tokens(src)} tk)")


def _token_at(src: str, pos_expr: str) -> str:
    """Lines of ``src`` with ``pos`` and the first sorted token covering it."""
    return f"""(
  SELECT l.file, l.line_no, l.pos, c.type, c.value FROM
    (SELECT file, line_no, {pos_expr} AS pos FROM {src} s) l
  LEFT JOIN (
    SELECT t.file, t.line_no, l2.pos, t.type, t.value,
           row_number() OVER (PARTITION BY t.file, t.line_no ORDER BY t.rn) AS pick
    FROM {_sorted_tokens(src)} t
    JOIN (SELECT file, line_no, {pos_expr} AS pos FROM {src} s) l2
      ON t.file = l2.file AND t.line_no = l2.line_no AND t.start_pos <= l2.pos AND l2.pos < t.end_pos
  ) c ON c.file = l.file AND c.line_no = l.line_no AND c.pick = 1
)"""


def _first_digits(marker: str) -> str:
    return f"regexp_extract(raw, '{marker}(\\d+)', 1)"


def _drill_lines(keys_sql: str, join_on: str, kind: str, key_conn: str, key_value: str) -> str:
    return (f"SELECT '{kind}' AS kind, {key_conn} AS key_conn, {key_value} AS key_value, p.file, p.line_no "
            f"FROM {P} p JOIN ({keys_sql}) k ON p.file = k.file AND {join_on}")


def _ordinal(src: str, extra: str = "") -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS ord "
            f"FROM {src} x {extra})")


# label as printed -> condition
_LABELLED_SQL = {
    "err=49 > text:SEARCH": "coalesce(error_code = '49', false) AND contains(raw, 'SEARCH')",
    "base=ou=g3,dc=example": "coalesce(base = 'ou=g3,dc=example', false)",
    "conn=8 > op=4": "coalesce(conn_id = '8', false) AND coalesce(op_id = '4', false)",
}

_DOCS = O.doc_lines()
_VISIBLE_ERR = _ordinal(f"(SELECT file, line_no, value, conn_id, dn FROM {P} p WHERE error_code = '{ERR}')")


def _numbered_docs() -> str:
    vis = _ordinal(_DOCS)
    hits = (f"(SELECT file, line_no, ord, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS match_ord, "
            f"count(*) OVER (PARTITION BY file) AS n FROM {vis} v WHERE contains(value, '{DOC_QUERY}'))")
    return hits


ORACLE: dict[str, str] = {
    "ts_debug_decode": f"SELECT file, line_no, raw, ts_text, {_ts_us()} AS ts_us FROM {O.parsed('debug', 'debug')} p",
    "ts_syslog_utc": f"SELECT file, line_no, raw, ts_text, {_ts_us()} AS ts_us FROM {O.parsed('syslog', 'syslog-utc')} p",
    "ts_syslog_local": f"SELECT file, line_no, raw, ts_text FROM {O.parsed('syslog', 'syslog-local')} p",
    "ts_auto_mixed": f"SELECT file, line_no, raw, ts_text FROM {P} p",
    "fields_core": f"SELECT file, line_no, thread_id, conn_id, op_id, dn, ldap_filter, base, error_code FROM {P} p",
    "fields_extra": (f"SELECT file, line_no, ip, fd, tag, etime, qtime, scope, deref, attrs, nentries, "
                     f"TRY_CAST(etime AS DOUBLE) AS etime_s, TRY_CAST(qtime AS DOUBLE) AS qtime_s, "
                     f"TRY_CAST(nentries AS BIGINT) AS nentries_n FROM {P} p"),
    "keywords": (f"SELECT p.file, p.line_no, coalesce(string_agg(t.value, ',' ORDER BY t.start_pos), '') AS keywords "
                 f"FROM {P} p LEFT JOIN {O.tokens(P)} t ON t.file = p.file AND t.line_no = p.line_no AND t.type = 'KEYWORD' "
                 f"GROUP BY p.file, p.line_no"),
    "tokens_exploded": (f"SELECT file, line_no, CAST(rn - 1 AS INTEGER) AS token_idx, CAST(start_pos AS INTEGER) AS start_pos, "
                        f"CAST(end_pos AS INTEGER) AS end_pos, type, value FROM {_sorted_tokens(P)} t"),
    "token_at_pos": f"SELECT file, line_no, pos, type, value FROM {_token_at(P, '(line_no * 7) % 80')} z",
    "filter_conn": f"SELECT file, line_no, raw FROM {P} p WHERE conn_id = '{CONN}'",
    "filter_dn": f"SELECT file, line_no, raw FROM {P} p WHERE dn = {_q(DN)}",
    "filter_op": f"SELECT file, line_no, raw FROM {P} p WHERE op_id = '{OP}'",
    "filter_base": f"SELECT file, line_no, raw FROM {P} p WHERE base = {_q(BASE)}",
    "filter_err": f"SELECT file, line_no, raw FROM {P} p WHERE error_code = '{ERR}'",
    "filter_thread": f"SELECT file, line_no, raw FROM {P} p WHERE thread_id = '{THREAD}'",
    "filter_text": f"SELECT file, line_no, raw FROM {P} p WHERE contains(raw, {_q(TEXT)})",
    "filter_range": f"SELECT file, line_no, raw FROM {P} p WHERE conn_id = '{CONN}' AND line_no BETWEEN 100 AND 2000",
    "filter_range_open": (f"SELECT 'start' AS open, file, line_no FROM {P} p WHERE conn_id = '{CONN}' AND line_no <= 700 "
                          f"UNION ALL SELECT 'end' AS open, file, line_no FROM {P} p WHERE conn_id = '{CONN}' AND line_no >= 700"),
    "filter_stack": (f"SELECT file, line_no, raw FROM {P} p WHERE contains(raw, 'SRCH') AND base = {_q(BASE)} "
                     f"AND line_no BETWEEN 500 AND 1500"),
    "filter_candidates": f"""SELECT file, line_no,
    regexp_matches(value, 'conn={CONN}([^0-9]|$)') AND contains(value, '{THREAD}') AS candidate,
    coalesce(conn_id = '{CONN}', false) AND coalesce(thread_id = '{THREAD}', false) AS exact
  FROM {P} p""",
    "filter_labels": "\nUNION ALL\n".join(
        f"SELECT file, line_no, {_q(label)} AS filter_label FROM {P} p WHERE {where}" for label, where in _LABELLED_SQL.items()),
    "conn_ranges": (f"SELECT file, conn_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines "
                    f"FROM {P} p WHERE conn_id IS NOT NULL GROUP BY file, conn_id"),
    "conn_lines": f"SELECT file, line_no, value FROM {P} p WHERE conn_id = '{CONN}'",
    "visible_counts": (f"SELECT file, count(*) FILTER (WHERE coalesce(error_code = '{ERR}', false)) AS visible, "
                       f"count(*) AS total FROM {P} p GROUP BY file"),
    "drill_conn": _drill_lines(
        f"SELECT DISTINCT file, {_first_digits('conn=')} AS c FROM {P} s WHERE error_code = '{ERR}' AND contains(raw, 'conn=')",
        "p.conn_id = k.c", "conn", "p.conn_id", "CAST(NULL AS VARCHAR)"),
    "drill_dn": _drill_lines(
        f"SELECT DISTINCT file, conn_id AS c FROM {P} s WHERE dn IS NOT NULL AND contains(raw, 'BIND') "
        f"AND contains(raw, 'dn=\"') AND conn_id IS NOT NULL",
        "p.conn_id = k.c", "conn", "p.conn_id", "CAST(NULL AS VARCHAR)"),
    "drill_op": _drill_lines(
        f"SELECT DISTINCT file, conn_id AS c, {_first_digits('op=')} AS o FROM {P} s "
        f"WHERE error_code = '{ERR}' AND contains(raw, 'op=') AND conn_id IS NOT NULL",
        "p.conn_id = k.c AND p.op_id = k.o", "op", "p.conn_id", "p.op_id"),
    "drill_thread": _drill_lines(
        f"SELECT DISTINCT file, thread_id AS t FROM {P} s WHERE contains(raw, 'ACCEPT') AND thread_id IS NOT NULL "
        f"AND contains(raw, '0x7f')",
        "p.thread_id = k.t", "thread", "CAST(NULL AS VARCHAR)", "p.thread_id"),
    "drill_err": _drill_lines(
        f"SELECT DISTINCT file, {_first_digits('err=')} AS e FROM {P} s WHERE error_code = '{ERR}' AND contains(raw, 'err=')",
        "p.error_code = k.e", "err", "CAST(NULL AS VARCHAR)", "p.error_code"),
    "drill_base": _drill_lines(
        f"SELECT DISTINCT file, regexp_extract(raw, 'base=\"([^\"]*)\"', 1) AS b FROM {P} s "
        f"WHERE base IS NOT NULL AND contains(raw, 'base=\"') AND regexp_extract(raw, 'base=\"([^\"]*)\"', 1) <> ''",
        "p.base = k.b", "base", "CAST(NULL AS VARCHAR)", "p.base"),
    "drill_filter": _drill_lines(
        f"SELECT DISTINCT file, regexp_extract(raw, 'filter=\"([^\"]*)\"', 1) AS n FROM {P} s "
        f"WHERE ldap_filter IS NOT NULL AND contains(raw, 'filter=\"') "
        f"AND regexp_extract(raw, 'filter=\"([^\"]*)\"', 1) <> ''",
        "contains(p.raw, k.n)", "text", "CAST(NULL AS VARCHAR)", "k.n"),
    "drill_attrs": _drill_lines(
        f"SELECT DISTINCT file, attrs AS n FROM {P} s WHERE attrs IS NOT NULL AND contains(raw, 'cn uid')",
        "contains(p.raw, k.n)", "text", "CAST(NULL AS VARCHAR)", "k.n"),
    "drill_noop": _drill_lines(
        f"SELECT DISTINCT file, {_first_digits('err=')} AS e FROM {P} s WHERE error_code = '{ERR}' AND contains(raw, 'err=')",
        "p.error_code = k.e", "err", "CAST(NULL AS VARCHAR)", "p.error_code"),
    "drill_linked": f"""
SELECT s.file, s.line_no, 'op' AS kind, s.conn_id AS key_conn, s.o AS key_value, count(*) AS n_lines
FROM (SELECT file, line_no, conn_id, {_first_digits('op=')} AS o FROM {P} x
      WHERE error_code = '{ERR}' AND contains(raw, 'op=')) s
JOIN {P} p ON p.file = s.file AND p.conn_id = s.conn_id AND p.op_id = s.o GROUP BY ALL
UNION ALL
SELECT s.file, s.line_no, 'base', NULL, s.b, n FROM (
  SELECT file, line_no, regexp_extract(raw, 'base="([^"]*)"', 1) AS b FROM {P} x WHERE base IS NOT NULL AND contains(raw, 'base="')) s
JOIN (SELECT file, base, count(*) AS n FROM {P} p GROUP BY ALL) t ON t.file = s.file AND t.base = s.b WHERE s.b <> ''
UNION ALL
SELECT s.file, s.line_no, 'thread', NULL, s.thread_id, n FROM (
  SELECT file, line_no, thread_id FROM {P} x WHERE contains(raw, 'ACCEPT') AND thread_id IS NOT NULL AND contains(raw, '0x7f')) s
JOIN (SELECT file, thread_id, count(*) AS n FROM {P} p GROUP BY ALL) t ON t.file = s.file AND t.thread_id = s.thread_id""",
    "drill_chain": _drill_lines(
        f"SELECT DISTINCT file, {_first_digits('conn=')} AS c FROM {P} s WHERE error_code = '{ERR}' AND contains(raw, 'conn=')",
        "p.conn_id = k.c AND contains(p.raw, 'SRCH')", "conn", "p.conn_id", "CAST(NULL AS VARCHAR)"),
    "stack_undo": (f"SELECT 'pop' AS undo, file, line_no FROM {P} p WHERE conn_id = '{CONN}' "
                   f"UNION ALL SELECT 'clear' AS undo, file, line_no FROM {P} p"),
    "search_lines": (f"SELECT file, count(*) AS n_matches, min(line_no) AS first_line FROM {_DOCS} d "
                     f"WHERE contains(value, '{DOC_QUERY}') GROUP BY file"),
    "search_numbered": f"""SELECT file, line_no, ord, match_ord, n AS n_matches,
  (match_ord + 1) % n AS next_match_ord, (match_ord + n - 1) % n AS prev_match_ord
FROM (SELECT file, line_no, ord, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS match_ord,
             count(*) OVER (PARTITION BY file) AS n
      FROM {_ordinal(f"(SELECT file, line_no, value FROM {P} p WHERE contains(raw, 'SRCH'))")} v
      WHERE contains(value, 'attr=')) h""",
    "search_next_prev": f"""WITH h AS {_numbered_docs()}
SELECT a.file, a.line_no, a.match_ord, nx.line_no AS next_line_no, pv.line_no AS prev_line_no
FROM h a JOIN h nx ON nx.file = a.file AND nx.match_ord = (a.match_ord + 1) % a.n
         JOIN h pv ON pv.file = a.file AND pv.match_ord = (a.match_ord + a.n - 1) % a.n""",
    "search_many": (f"SELECT p.file, p.line_no, k.q AS query FROM {P} p JOIN (SELECT DISTINCT file, concat('conn=', conn_id, ' ') AS q "
                    f"FROM {P} s WHERE error_code = '{ERR}') k ON p.file = k.file AND contains(p.value, k.q)"),
    "search_first_pos": (f"SELECT file, line_no, CAST(strlen(split_part(value, '{SPAN_QUERY}', 1)) AS INTEGER) AS first_pos "
                         f"FROM {_DOCS} d WHERE contains(value, '{SPAN_QUERY}')"),
    "search_spans": f"""SELECT file, line_no, CAST(i AS INTEGER) AS span_idx,
  CAST(coalesce(list_sum(list_transform(pcs[1:i + 1], lambda x: strlen(x))), 0) + i * strlen('{SPAN_QUERY}') AS INTEGER) AS start_pos,
  CAST(coalesce(list_sum(list_transform(pcs[1:i + 1], lambda x: strlen(x))), 0) + (i + 1) * strlen('{SPAN_QUERY}') AS INTEGER) AS end_pos
FROM (SELECT file, line_no, pcs, unnest(range(0, len(pcs) - 1)) AS i
      FROM (SELECT file, line_no, string_split(value, '{SPAN_QUERY}') AS pcs FROM {_DOCS} d
            WHERE contains(value, '{SPAN_QUERY}')) a) b""",
    "search_from_token": f"""SELECT file, line_no, coalesce(query, '') AS query FROM (
  SELECT file, line_no, CASE type
    WHEN 'CONN_ID' THEN value[6:] WHEN 'OP_ID' THEN value[4:] WHEN 'ERROR_CODE' THEN value[5:]
    WHEN 'DN_VALUE' THEN value[5:length(value) - 1] WHEN 'THREAD_ID' THEN value ELSE '' END AS query
  FROM {_token_at(f"(SELECT file, line_no, raw FROM {P} p)", '(line_no * 7) % 80')} z) y""",
    "ordinals": f"SELECT file, line_no, ord FROM {_VISIBLE_ERR} v",
    "page": f"SELECT file, line_no, ord FROM {_VISIBLE_ERR} v WHERE ord >= 20 AND ord < 45",
    "page_at": f"SELECT file, line_no, ord FROM {_VISIBLE_ERR} v WHERE ord >= 20 AND ord < 45",
    "goto_at": f"SELECT file, line_no, ord FROM {_VISIBLE_ERR} v WHERE ord = 14",
    "goto": f"SELECT file, line_no, ord FROM {_VISIBLE_ERR} v WHERE ord = 14",
    "first_last": (f"SELECT file, min(line_no) AS first_line_no, arg_min(value, line_no) AS first_value, "
                   f"max(line_no) AS last_line_no, arg_max(value, line_no) AS last_value FROM {_VISIBLE_ERR} v GROUP BY file"),
    "line_status": (f"SELECT p.file, p.line_no, p.line_no + 1 AS line_number, t.n AS total_lines, p.conn_id, p.dn "
                    f"FROM {P} p JOIN (SELECT file, count(*) AS n FROM {P} q GROUP BY file) t ON t.file = p.file "
                    f"WHERE p.dn = {_q(DN)}"),
}

ORACLE["failed_connections"] = f"""WITH k AS (
  SELECT DISTINCT file, {_first_digits('conn=')} AS c FROM {P} s WHERE error_code = '{ERR}' AND contains(raw, 'conn=')),
r AS (SELECT file, conn_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines
      FROM {P} q WHERE conn_id IS NOT NULL GROUP BY file, conn_id)
SELECT p.file, p.conn_id, p.line_no, r.first_line, r.last_line, r.n_lines, p.value
FROM {P} p JOIN k ON p.file = k.file AND p.conn_id = k.c JOIN r ON r.file = p.file AND r.conn_id = p.conn_id"""

_L = O.lines("mixed")
# Layout of the written files by number modulo 4: codec; 1 has CR LF line ends, 2 no final newline.
_NUMBER = "CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) % 4"
_CODEC_CASE = f"CASE {_NUMBER} WHEN 0 THEN 'none' WHEN 1 THEN 'gzip' WHEN 2 THEN 'bzip2' ELSE 'xz' END"


def _tail_sql(kind: str, eol: str, skip: str) -> str:
    """The last 10 terminated lines of each file; ``eol``: bytes of a line's end, ``skip``: last lines that have none."""
    return f"""SELECT '{kind}' AS kind, file, b - {skip} AS back, byte_pos, value FROM (
  SELECT file, value, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS b,
    CAST(coalesce(sum(strlen(value) + {eol}) OVER (PARTITION BY file ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_pos
  FROM {_L} l) z WHERE b - {skip} BETWEEN 1 AND 10"""


ORACLE.update({
    "scan_text": f"SELECT file, line_no, value FROM {_L} l",
    "scan_splits": f"SELECT file, line_no, value FROM {_L} l",
    "scan_auto": f"SELECT file, line_no, value FROM {_L} l",
    "line_counts": (f"SELECT file, count(*) AS n_lines FROM {_L} l GROUP BY file "
                    f"UNION ALL SELECT 'slapd-empty.log' AS file, CAST(0 AS BIGINT) AS n_lines"),
    "slice_lines": f"SELECT file, line_no, value FROM {_L} l WHERE line_no >= 100 AND line_no < 150",
    "tail_lines": _tail_sql("text", f"(CASE WHEN {_NUMBER} = 1 THEN 2 ELSE 1 END)", f"(CASE WHEN {_NUMBER} = 2 THEN 1 ELSE 0 END)")
                  + "\nUNION ALL\n" + _tail_sql("compressed", "1", "0"),
    "codec_detect": f"SELECT DISTINCT file, {_CODEC_CASE} AS codec FROM {_L} l",
    "scan_compressed": f"SELECT file, line_no, value, {_CODEC_CASE} AS codec FROM {_L} l",
    "scan_pieces": f"SELECT file, line_no, value, {_CODEC_CASE} AS codec FROM {_L} l",
    "ingest_roundtrip": f"SELECT file, line_no, ts_text, conn_id, op_id, error_code, raw FROM {P} p",
})


def _bytes_before(src: str) -> str:
    return (f"coalesce(sum(strlen(value) + 1) OVER (PARTITION BY file ORDER BY line_no "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


def _follow_sql(phases: list[tuple[str, int, str, bool]]) -> str:
    """Union of follow outputs: (line predicate, generation, content predicate, tail only)."""
    parts = []
    for pred, gen, content, tail_only in phases:
        seg = (f"SELECT file, line_no, value, {_bytes_before('x')} AS byte_pos, "
               f"row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS back "
               f"FROM (SELECT * FROM {P} p WHERE {content}) x")
        keep = "back <= 10" if tail_only else "true"
        parts.append(f"SELECT file, CAST({gen} AS INTEGER) AS generation, byte_pos, value, conn_id FROM "
                     f"(SELECT s.*, p2.conn_id FROM ({seg}) s JOIN {P} p2 USING (file, line_no)) y "
                     f"WHERE {keep} AND {pred}")
    return "\nUNION ALL\n".join(parts)


_N = "(SELECT max(line_no) + 1 FROM " + O.lines("mixed") + " q)"

ORACLE.update({
    # phase 1 = first half; its last 10 lines, then every line of the second half
    "follow_append": _follow_sql([
        ("true", 0, f"line_no < {_N} // 2", True),
        (f"line_no >= {_N} // 2", 0, "true", False),
    ]),
    # generation 0: last 10 lines of the first 3/5; generation 1 (file rewritten
    # with the 4th fifth, then the last fifth appended): every line
    "follow_rotate": _follow_sql([
        ("true", 0, f"line_no < {_N} * 3 // 5", True),
        ("true", 1, f"line_no >= {_N} * 3 // 5", False),
    ]),
    # generation 0: last 10 lines of the first 3/5, and the 4th fifth, appended and then
    # renamed away before it was read; generation 1: the last fifth in new files
    "follow_rename": _follow_sql([
        ("true", 0, f"line_no < {_N} * 3 // 5", True),
        (f"line_no >= {_N} * 3 // 5", 0, f"line_no < {_N} * 4 // 5", False),
        ("true", 1, f"line_no >= {_N} * 4 // 5", False),
    ]),
    # generation 0: last 10 lines of the first fifth; generation 1: new files that begin with
    # the same fifth, from their first line
    "follow_same_head": _follow_sql([
        ("true", 0, f"line_no < {_N} // 5", True),
        ("true", 1, "true", False),
    ]),
    "stream_parse": f"SELECT file, ts_text, conn_id, op_id, error_code, raw FROM {P} p",
    "stream_filter": (f"SELECT file, conn_id, raw FROM {P} p WHERE error_code = '{ERR}' "
                      f"AND contains(raw, 'SEARCH')"),
})
_POS = f"SELECT *, {_bytes_before('l')} AS byte_pos, count(*) OVER (PARTITION BY file) AS n_lines FROM {_L} l"
ORACLE.update({
    "index_lines": f"SELECT file, line_no, byte_pos, value, (SELECT count(*) FROM {_L} k WHERE line_no >= {_N} // 2) AS n_added FROM ({_POS}) x",
    "slice_raw": f"SELECT file, line_no, value, line_no + 1 AS number, n_lines FROM ({_POS}) x WHERE line_no >= 100 AND line_no < 150",
    "tail_numbered": f"SELECT file, line_no, byte_pos, value FROM ({_POS}) x WHERE line_no >= n_lines - 10",
})
ORACLE["follow_compacted"] = ORACLE["follow_append"]
ORACLE["follow_table"] = (f"SELECT f.*, (SELECT count(*) FROM {_L} l WHERE line_no >= {_N} // 2) AS n_added "
                          f"FROM ({ORACLE['follow_append']}) f")
