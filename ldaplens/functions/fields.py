"""Field extraction (E1-E17): one Catalyst expression per column, no UDF.

Every scalar field follows "last occurrence wins": the value is the capture of
the last non-overlapping match in the normalised line (``raw``). Absent is
NULL; a quoted empty body (``dn=""``) is a present empty string. No pattern
has a left word boundary, so ``stop=5`` sets ``op_id`` and ``newrdn="x"``
sets ``dn`` -- substring semantics are kept on purpose.

Each field is an independent expression, so Catalyst's column pruning drops
the regex of any field a query does not select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldaplens.functions.timestamps import RFC3339_STAMP, normalize_frame, ts_from_text, ts_text

# Field patterns (Java regex); group 1 is the stored value. The
# list's group is possessive: the same match without a stack frame per word.
FIELD_PATTERNS = {
    "thread_id": RFC3339_STAMP + r"\s+(0x[0-9a-fA-F]{8,16})",
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
    "attrs": r"attr=(\S+(?:\s\S+)*+)",
    "nentries": r"nentries=(\d+)",
}

# A literal every match of the field's pattern contains; lines
# without it skip the regex (a substring test is far cheaper than a regex scan).
FIELD_ANCHORS = {
    "thread_id": "0x", "conn_id": "conn=", "op_id": "op=", "dn": 'dn="', "ldap_filter": 'filter="',
    "base": 'base="', "error_code": "err=", "ip": "IP=", "fd": "fd=", "tag": "tag=", "etime": "etime=",
    "qtime": "qtime=", "scope": "scope=", "deref": "deref=", "attrs": "attr=", "nentries": "nentries=",
}

# The seven fields a viewer stores per line; the rest are token-only there.
CORE_FIELDS = ("thread_id", "conn_id", "op_id", "dn", "ldap_filter", "base", "error_code")
EXTRA_FIELDS = ("ip", "fd", "tag", "etime", "qtime", "scope", "deref", "attrs", "nentries")
ALL_FIELDS = CORE_FIELDS + EXTRA_FIELDS


def last_match(raw: Column, pattern: str) -> Column:
    """Capture group 1 of the last match of ``pattern`` in ``raw``, NULL if none."""
    return F.try_element_at(F.regexp_extract_all(raw, F.lit(pattern), 1), F.lit(-1))


def field(name: str, raw="raw") -> Column:
    r = F.col(raw) if isinstance(raw, str) else raw
    return F.when(r.contains(FIELD_ANCHORS[name]), last_match(r, FIELD_PATTERNS[name])).alias(name)


def strip_cr(value="value") -> Column:
    """Drop exactly one trailing carriage return (a second one is line content)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.endswith("\r"), v.substr(F.lit(1), F.length(v) - 1)).otherwise(v)


def with_fields(df: DataFrame, fields=ALL_FIELDS, raw: str = "raw") -> DataFrame:
    """Add the selected field columns computed from ``raw``."""
    return df.select("*", *[field(n, raw) for n in fields])


def fence(df: DataFrame) -> DataFrame:
    """An optimizer barrier: later filters stay above the columns computed so far.

    Catalyst pushes a filter below a projection by substituting each column with
    the expression that computes it; through the staged head normalisation that
    multiplies the regexes in the predicate (planning time and per-row work both
    explode). Re-emitting the rows through ``inline`` (a generator) stops the
    substitution: the line is normalised once and what follows reads a column.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def parse_logs(
    df: DataFrame,
    fmt: str = "auto",
    as_of=None,
    tz: str | None = None,
    fields=ALL_FIELDS,
    typed: bool = True,
    fenced: bool = True,
) -> DataFrame:
    """Lines (``value`` column, plus any keys) -> parsed rows.

    Works on batch and streaming DataFrames alike (S11): it is a pure
    projection. Typed companions (``etime_s``, ``qtime_s``, ``nentries_n``,
    ``conn_n``, ``err_n``) are added with ``try_cast`` for analytics; filters
    compare the string columns, as the viewer does.

    Only the normalised line is ``fence``d (see there). Fields are projections of
    it, so a query pays for the fields it selects or filters by, and no others.
    """
    with_raw = normalize_frame(df, fmt, as_of, tz)
    if fenced and fmt != "rfc3339":
        with_raw = fence(with_raw)
    stamp = ts_text(F.col("raw"))
    out = with_raw.select("*", stamp.alias("ts_text"), *[field(n) for n in fields])
    out = out.withColumn("ts", ts_from_text(F.col("ts_text")))
    if typed:
        extras = []
        if "etime" in fields:
            extras.append(F.col("etime").try_cast("double").alias("etime_s"))
        if "qtime" in fields:
            extras.append(F.col("qtime").try_cast("double").alias("qtime_s"))
        if "nentries" in fields:
            extras.append(F.col("nentries").try_cast("bigint").alias("nentries_n"))
        if extras:
            out = out.select("*", *extras)
    return out
