"""Independent SQL (DuckDB dialect) for every registered query.

These statements re-derive the same log lines from the driver's tables and
re-implement each operator's semantics in plain SQL (RE2 regexes, list
functions, window functions). They are the correctness oracle: the Spark
plans in ``plans.queries`` must return the same rows.
"""

from __future__ import annotations

# Fixed values shared with the Spark side.
AS_OF_YEAR, AS_OF_MONTH = 2024, 6
LOCAL_TZ = "America/New_York"

_BODY = """
  CASE e % 6
    WHEN 0 THEN 'fd=' || (e % 64) || ' ACCEPT from IP=10.0.' || (u % 256) || '.' || (e % 256) || ':' || (1024 + e % 60000) || ' (IP=0.0.0.0:389)'
    WHEN 1 THEN 'op=0 BIND dn="uid=u' || u || ',ou=People,dc=example" method=128'
    WHEN 2 THEN 'op=' || (e % 50) || ' SRCH base="ou=g' || (u % 7) || ',dc=example" scope=2 deref=0 filter="(uid=u' || u || ')"'
    WHEN 3 THEN 'op=' || (e % 50) || ' SRCH attr=cn uid mail'
    WHEN 4 THEN 'op=' || (e % 50) || ' SEARCH RESULT tag=101 err=' || err || ' qtime=0.000012 etime=0.000345 nentries=' || (e % 20) || ' text='
    ELSE 'op=' || (e % 50) || ' UNBIND' END"""


def lines(head: str = "mixed") -> str:
    """Subquery ``(file, line_no, value)`` of derived slapd lines."""
    debug = "lower(hex(us // 1000000)) || '.' || lpad(lower(hex(us % 1000000)), 5, '0') || ' ' || thread || tail"
    syslog = ("strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S')"
              " || ' ldap' || (u % 3) || ' slapd[' || (100 + u % 5) || ']:' || tail")
    rfc = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || thread || tail"
    value = {
        "debug": debug,
        "syslog": syslog,
        "rfc3339": rfc,
        "mixed": f"CASE e % 3 WHEN 0 THEN {debug} WHEN 1 THEN {syslog} ELSE {rfc} END",
    }[head]
    return f"""(
  SELECT 'slapd-' || (e // 2500) || '.log' AS file, e % 2500 AS line_no, {value} AS value
  FROM (
    SELECT e, u, ts, us, '0x7f' || lpad(lower(hex(u)), 10, '0') AS thread,
           ' conn=' || u || ' ' || {_BODY} AS tail
    FROM (SELECT event_id AS e, user_id AS u, ts, epoch_us(ts) AS us,
                 CASE WHEN event_type = 'error' THEN '49' ELSE '0' END AS err FROM events) ev0
  ) ev1
)"""


def doc_lines() -> str:
    return """(
  SELECT 'doc-' || doc_id AS file, CAST(i - 1 AS BIGINT) AS line_no,
         CASE WHEN suffix(v, chr(13)) THEN v[1:length(v) - 1] ELSE v END AS value
  FROM (SELECT doc_id, unnest(parts) AS v, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d0) d1
)"""


# The line heads and, below, the stamp, field, token and keyword patterns of the
# log format (RE2 here), as the Spark side states them for Java.
_DEBUG_RE = r"^([0-9a-fA-F]+)\.([0-9a-fA-F]{5,8})[ \t]+([^ \t]*)[ \t]*(.*)$"
_SYSLOG_RE = r"^([A-Za-z]{3})[ ]+([0-9]{1,2})[ ]+([0-9]{2}):([0-9]{2}):([0-9]{2})[ ]+(.*)$"


def _debug_decode(v: str) -> str:
    g = lambda k: f"regexp_extract({v}, '(?s){_DEBUG_RE}', {k})"
    frac = f"CAST(CAST('0x' || {g(2)} AS UBIGINT) AS VARCHAR)"
    width = f"CASE WHEN strlen({g(2)}) <= 5 THEN 6 ELSE 9 END"
    return (f"strftime(make_timestamp(CAST('0x' || {g(1)} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || "
            f"lpad({frac}, CAST(greatest({width}, strlen({frac})) AS INTEGER), '0') || 'Z' || "
            f"CASE WHEN {g(3)} <> '' THEN ' ' || {g(3)} ELSE '' END || "
            f"CASE WHEN {g(4)} <> '' THEN ' ' || {g(4)} ELSE '' END")


def _syslog_wall(v: str) -> str:
    g = lambda k: f"regexp_extract({v}, '(?s){_SYSLOG_RE}', {k})"
    mon = f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({g(1)}))"
    year = f"greatest(CASE WHEN {mon} > {AS_OF_MONTH} THEN {AS_OF_YEAR - 1} ELSE {AS_OF_YEAR} END, 1970)"
    secs = (f"date_diff('day', DATE '1970-01-01', make_date({year}, {mon}, 1)) * 86400 + "
            f"(CAST({g(2)} AS BIGINT) - 1) * 86400 + CAST({g(3)} AS BIGINT) * 3600 + "
            f"CAST({g(4)} AS BIGINT) * 60 + CAST({g(5)} AS BIGINT)")
    return f"make_timestamp(({secs}) * 1000000)", g(6), mon


def _syslog_decode(v: str, local: bool = False) -> str:
    wall, rest, mon = _syslog_wall(v)
    if local:
        wall = f"timezone('UTC', timezone('{LOCAL_TZ}', {wall}))"
    return f"CASE WHEN {mon} IS NOT NULL THEN strftime({wall}, '%Y-%m-%dT%H:%M:%S') || '.000000000Z ' || {rest} ELSE {v} END"


def normalize(v: str, fmt: str) -> str:
    debug_head = f"regexp_matches({v}, '^[0-9a-fA-F]+\\.[0-9a-fA-F]{{5,8}}[ \\t]+')"
    syslog_head = f"regexp_matches({v}, '^[A-Za-z]{{3}}[ ]+[0-9]{{1,2}}[ ]+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[ ]+')"
    if fmt == "rfc3339":
        return v
    if fmt == "debug":
        return f"CASE WHEN {debug_head} THEN {_debug_decode(v)} ELSE {v} END"
    if fmt == "syslog-utc":
        return f"CASE WHEN {syslog_head} THEN {_syslog_decode(v)} ELSE {v} END"
    if fmt == "syslog-local":
        return f"CASE WHEN {syslog_head} THEN {_syslog_decode(v, True)} ELSE {v} END"
    return (f"CASE WHEN {debug_head} THEN {_debug_decode(v)} "
            f"WHEN {syslog_head} THEN {_syslog_decode(v)} ELSE {v} END")


STAMP_RE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z"
FIELD_RE = {
    "thread_id": STAMP_RE + r"\s+(0x[0-9a-fA-F]{8,16})",
    "conn_id": r"conn=(\d+)",
    "op_id": r"op=(\d+)",
    "dn": r'dn="([^"]*)"',
    "ldap_filter": r'filter="([^"]*)"',
    "base": r'base="([^"]*)"',
    "error_code": r"err=(\d+)",
    "ip": r"IP=(\d+\.\d+\.\d+\.\d+:\d+)",
    "fd": r"fd=(\d+)",
    "tag": r"tag=(\d+)",
    "etime": r"etime=([0-9.]+)",
    "qtime": r"qtime=([0-9.]+)",
    "scope": r"scope=(\d+)",
    "deref": r"deref=(\d+)",
    "attrs": r"attr=(\S+(?:\s\S+)*)",
    "nentries": r"nentries=(\d+)",
}


def parsed(head: str = "mixed", fmt: str = "auto", src: str | None = None) -> str:
    """Subquery with ``file, line_no, value, raw, ts_text`` and every field."""
    src = src or lines(head)
    fields = ",\n    ".join(f"regexp_extract_all(raw, '{p}', 1)[-1] AS {n}" for n, p in FIELD_RE.items())
    return f"""(
  SELECT file, line_no, value, raw,
    NULLIF(regexp_extract(raw, '{STAMP_RE}', 0), '') AS ts_text,
    {fields}
  FROM (SELECT file, line_no, value, {normalize('value', fmt)} AS raw FROM {src} s0) s1
)"""


# ------------------------------------------------------------------ tokens
TOKEN_RE = [
    ("CONN_ID", r"conn=\d+"), ("OP_ID", r"op=\d+"), ("DN_VALUE", r'dn="[^"]*"'),
    ("FILTER_VALUE", r'filter="[^"]*"'), ("BASE", r'base="[^"]*"'),
    ("IP_ADDRESS", r"IP=\d+\.\d+\.\d+\.\d+:\d+"), ("ERROR_CODE", r"err=\d+"), ("FD_NUM", r"fd=\d+"),
    ("TAG", r"tag=\d+"), ("ETIME_VAL", r"etime=[0-9.]+"), ("QTIME_VAL", r"qtime=[0-9.]+"),
    ("SCOPE", r"scope=\d+"), ("DEREF", r"deref=\d+"), ("NENTRIES", r"nentries=\d+"),
    ("KEYWORD", r"SEARCH RESULT"),
]
KEYWORD_RE = r"\b(?:ACCEPT|TLS|BIND|SRCH|RESULT|UNBIND|closed|method=|mech=|text=)\b"


def _spans(pattern: str) -> str:
    """List of structs (s, m): byte start and text of each match of ``pattern`` in raw."""
    m = f"regexp_extract_all(raw, '{pattern}', 0)"
    pcs = f"regexp_split_to_array(raw, '{pattern}')"
    return (f"list_transform({m}, lambda x, i: {{'s': CAST(coalesce(list_sum(list_transform(list_slice({pcs}, 1, i), lambda p: strlen(p))), 0)"
            f" + coalesce(list_sum(list_transform(list_slice({m}, 1, i - 1), lambda q: strlen(q))), 0) AS INTEGER), 'm': x}})")


def tokens(src: str) -> str:
    """Rows ``(file, line_no, start_pos, end_pos, type, value)`` of every kept token."""
    parts = []
    parts.append(f"SELECT file, line_no, t.s AS start_pos, t.s + strlen(t.m) AS end_pos, 'TIMESTAMP' AS type, t.m AS value "
                 f"FROM (SELECT file, line_no, unnest({_spans(STAMP_RE)}[1:1]) AS t FROM {src} a) b")
    parts.append(f"SELECT file, line_no, t.s + strlen(t.m) - strlen(regexp_extract(t.m, '0x[0-9a-fA-F]{{8,16}}$', 0)), "
                 f"t.s + strlen(t.m), 'THREAD_ID', regexp_extract(t.m, '0x[0-9a-fA-F]{{8,16}}$', 0) "
                 f"FROM (SELECT file, line_no, unnest({_spans(STAMP_RE + r'\s+0x[0-9a-fA-F]{8,16}')}) AS t FROM {src} a) b")
    for kind, pat in TOKEN_RE:
        parts.append(f"SELECT file, line_no, t.s, t.s + strlen(t.m), '{kind}', t.m "
                     f"FROM (SELECT file, line_no, unnest({_spans(pat)}) AS t FROM {src} a) b")
    attr = r"attr=\S+(?:\s\S+)*"
    parts.append(f"SELECT file, line_no, t.s, t.s + 5, 'ATTR', 'attr=' "
                 f"FROM (SELECT file, line_no, unnest({_spans(attr)}) AS t FROM {src} a) b")
    parts.append(f"SELECT file, line_no, t.s + 5, t.s + strlen(t.m), 'ATTR_LIST', t.m[6:] "
                 f"FROM (SELECT file, line_no, unnest({_spans(attr)}) AS t FROM {src} a) b")
    others = "\n  UNION ALL ".join(parts)
    kw = (f"SELECT file, line_no, t.s AS start_pos, t.s + strlen(t.m) AS end_pos, 'KEYWORD' AS type, t.m AS value "
          f"FROM (SELECT file, line_no, unnest({_spans(KEYWORD_RE)}) AS t FROM {src} a) b")
    return f"""(
  WITH o AS ({others}),
  k AS ({kw})
  SELECT * FROM o
  UNION ALL
  SELECT * FROM k WHERE NOT EXISTS (
    SELECT 1 FROM o WHERE o.file = k.file AND o.line_no = k.line_no
      AND k.start_pos < o.end_pos AND o.start_pos < k.end_pos)
)"""
