"""Located tokens (K1-K5, E18) as array expressions.

Each pattern's matches and the gaps before them come from one anchored
``regexp_extract_all`` walk (see ``match_spans``); gap and match lengths are
summed with ``octet_length``, so offsets are bytes of the UTF-8 line, not
characters. Everything stays inside Catalyst's higher-order functions: no
Python UDF. ``with_tokens`` computes the non-keyword tokens in one projection
and the keyword overlap test in the next, so the ~20 regex walks run once
per line.

Tokens are heavy (~20 regex passes per line); compute them only when a
query selects them. The field columns of ``parse_logs`` are the fast path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldaplens.functions.fields import FIELD_PATTERNS
from ldaplens.functions.timestamps import RFC3339_STAMP

TOKEN_STRUCT = "struct<start_pos:int,end_pos:int,type:string,value:string>"

# Token type names, and the pattern whose whole match is the
# token for the simple types.
WHOLE_MATCH_TOKENS = (
    ("CONN_ID", r"conn=\d+"),
    ("OP_ID", r"op=\d+"),
    ("DN_VALUE", r'dn="[^"]*"'),
    ("FILTER_VALUE", r'filter="[^"]*"'),
    ("BASE", r'base="[^"]*"'),
    ("IP_ADDRESS", r"IP=\d+\.\d+\.\d+\.\d+:\d+"),
    ("ERROR_CODE", r"err=\d+"),
    ("FD_NUM", r"fd=\d+"),
    ("TAG", r"tag=\d+"),
    ("ETIME_VAL", r"etime=[0-9.]+"),
    ("QTIME_VAL", r"qtime=[0-9.]+"),
    ("SCOPE", r"scope=\d+"),
    ("DEREF", r"deref=\d+"),
    ("NENTRIES", r"nentries=\d+"),
    ("KEYWORD", r"SEARCH RESULT"),
)
# The key of each "key=<digits|dots|address>" token type.
KEYED_TOKENS = {
    "conn": "CONN_ID", "op": "OP_ID", "IP": "IP_ADDRESS", "err": "ERROR_CODE", "fd": "FD_NUM",
    "tag": "TAG", "etime": "ETIME_VAL", "qtime": "QTIME_VAL", "scope": "SCOPE", "deref": "DEREF",
    "nentries": "NENTRIES",
}
# A match of one of these never contains or overlaps a match of another (each
# is its key, "=", then digits, dots or ':'; no key occurs inside another key
# or after "="), so one alternation walk finds exactly the matches the
# separate walks would. Quoted bodies can hold other tokens and stay separate.
_KEYED = dict(WHOLE_MATCH_TOKENS)
KEYED_PATTERN = "|".join(_KEYED[t] for t in KEYED_TOKENS.values())
SEPARATE_TOKENS = tuple((t, p) for t, p in WHOLE_MATCH_TOKENS if t not in KEYED_TOKENS.values())
THREAD_TOKEN = RFC3339_STAMP + r"\s+0x[0-9a-fA-F]{8,16}"
ATTR_TOKEN = r"attr=\S+(?:\s\S+)*+"
# Single-word keywords. Word edges are ASCII ([A-Za-z0-9_]):
# a keyword must not touch a word character on its left; the bare words must
# not touch one on their right, while the three "x=" forms need one there.
KEYWORD_WORDS = ("ACCEPT", "TLS", "BIND", "SRCH", "RESULT", "UNBIND", "closed")
KEYWORD_ASSIGNS = ("method=", "mech=", "text=")
_W = "[A-Za-z0-9_]"
KEYWORD_PATTERN = (
    f"(?<!{_W})(?:{'|'.join(KEYWORD_WORDS)})(?!{_W})"
    f"|(?<!{_W})(?:{'|'.join(KEYWORD_ASSIGNS)})(?={_W})"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A literal every match of a type contains; a line without it is not walked.
TOKEN_ANCHORS = {
    "DN_VALUE": 'dn="', "FILTER_VALUE": 'filter="', "BASE": 'base="', "KEYWORD": "SEARCH RESULT",
}

# Matches whose ends are gathered in one array before the next one is begun.
SPAN_CHUNK = 128


def match_spans(text: Column, pattern: str) -> Column:
    r"""``array<struct<s:int, m:string>>``: byte start and text of every match.

    ``\G(?s:.*?)(P)`` walks the same leftmost, non-overlapping match sequence
    as a plain find loop over ``P``, and group 0 also carries the gap before
    each match; ``\G`` pins every attempt to the end of the previous match,
    so a failing tail search is linear, not quadratic. ``P`` must have no
    capturing group. The patterns are literals, compiled once per task.
    """
    walk = "\\G(?s:.*?)(" + pattern + ")"
    whole = F.regexp_extract_all(text, F.lit(walk), 0)
    hits = F.regexp_extract_all(text, F.lit(walk), 1)
    # running byte total of the walked text, in chunks: an append copies its array, so one
    # array of all ends would cost the square of the matches
    start = F.struct(F.lit(0).alias("at"), F.array().alias("part"), F.array().alias("done")).cast(
        "struct<at:int,part:array<int>,done:array<array<int>>>")

    def step(acc, x):
        at = acc["at"] + F.octet_length(x)
        return F.when(
            F.size(acc["part"]) < SPAN_CHUNK,
            F.struct(at.alias("at"), F.array_append(acc["part"], at).alias("part"), acc["done"].alias("done")),
        ).otherwise(F.struct(at.alias("at"), F.array(at).alias("part"), F.array_append(acc["done"], acc["part"]).alias("done")))

    ends = F.aggregate(whole, start, step, lambda acc: F.flatten(F.array_append(acc["done"], acc["part"])))
    return F.zip_with(
        hits, ends, lambda m, e: F.struct((e - F.octet_length(m)).alias("s"), m.alias("m"))
    )


def _tok(start: Column, end: Column, kind, value: Column, type_col: Column | None = None) -> Column:
    return F.struct(
        start.cast("int").alias("start_pos"),
        end.cast("int").alias("end_pos"),
        (type_col if type_col is not None else F.lit(kind)).alias("type"),
        value.alias("value"),
    )


def _spans_with(text: Column, pattern: str, anchor: str | None) -> Column:
    """``match_spans`` for a pattern whose every match contains ``anchor``: without it there is no walk."""
    if anchor is None:
        return match_spans(text, pattern)
    none = F.array().cast("array<struct<s:int,m:string>>")
    return F.when(~text.contains(anchor), none).otherwise(match_spans(text, pattern))


def _first_span(text: Column, pattern: str) -> Column:
    """The first span of ``match_spans`` alone: the rest of the text is not searched."""
    hit = F.regexp_extract(text, pattern, 0)
    walked = F.regexp_extract(text, "\\A(?s:.*?)(?:" + pattern + ")", 0)
    none = F.array().cast("array<struct<s:int,m:string>>")
    first = F.array(F.struct((F.octet_length(walked) - F.octet_length(hit)).alias("s"), hit.alias("m")))
    return F.when(hit == "", none).otherwise(first)


def _whole(raw: Column, kind: str, pattern: str, anchor: str | None = None) -> Column:
    return F.transform(
        _spans_with(raw, pattern, anchor), lambda x: _tok(x["s"], x["s"] + F.octet_length(x["m"]), kind, x["m"])
    )


def token_parts(raw="raw") -> tuple[Column, Column]:
    """(non-keyword tokens, keyword candidates) of the normalised line."""
    r = _col(raw)
    stamp = F.transform(
        _first_span(r, RFC3339_STAMP),
        lambda x: _tok(x["s"], x["s"] + F.octet_length(x["m"]), "TIMESTAMP", x["m"]),
    )

    def thread_tok(x):
        tid = F.regexp_extract(x["m"], r"0x[0-9a-fA-F]{8,16}$", 0)
        end = x["s"] + F.octet_length(x["m"])
        return _tok(end - F.octet_length(tid), end, "THREAD_ID", tid)

    threads = F.transform(_spans_with(r, THREAD_TOKEN, "0x"), thread_tok)
    attr_spans = _spans_with(r, ATTR_TOKEN, "attr=")
    attrs = F.transform(attr_spans, lambda x: _tok(x["s"], x["s"] + 5, "ATTR", F.lit("attr=")))
    attr_lists = F.transform(
        attr_spans,
        lambda x: _tok(x["s"] + 5, x["s"] + F.octet_length(x["m"]), "ATTR_LIST", F.substring(x["m"], 6, 1 << 30)),
    )
    key_type = F.create_map(*[x for k, t in KEYED_TOKENS.items() for x in (F.lit(k), F.lit(t))])
    keyed = F.transform(
        _spans_with(r, KEYED_PATTERN, "="),
        lambda x: _tok(x["s"], x["s"] + F.octet_length(x["m"]),
                       None, x["m"], type_col=F.element_at(key_type, F.substring_index(x["m"], "=", 1))),
    )
    others = F.concat(stamp, threads, keyed, *[_whole(r, k, p, TOKEN_ANCHORS[k]) for k, p in SEPARATE_TOKENS], attrs, attr_lists)
    return others, _whole(r, "KEYWORD", KEYWORD_PATTERN)


def combine_tokens(others: Column, candidates: Column) -> Column:
    """K2 + K3: drop keywords overlapping any other token, sort by start.

    Keyword matches never overlap each other (one non-overlapping scan), so
    only the other tokens need testing.
    """
    kept = F.filter(
        candidates,
        lambda k: ~F.exists(others, lambda o: (k["start_pos"] < o["end_pos"]) & (o["start_pos"] < k["end_pos"])),
    )
    return F.array_sort(F.concat(others, kept))


def tokens_col(raw="raw") -> Column:
    """K1-K3 as one expression (prefer ``with_tokens`` on DataFrames)."""
    others, candidates = token_parts(raw)
    return combine_tokens(others, candidates)


def keywords_col(tokens="tokens") -> Column:
    """Keyword texts in line order (after overlap suppression)."""
    t = _col(tokens)
    return F.transform(F.filter(t, lambda x: x["type"] == "KEYWORD"), lambda x: x["value"])


def with_tokens(df: DataFrame, raw: str = "raw", keywords: bool = True) -> DataFrame:
    """Add ``tokens`` (and ``keywords``) in two projections: the regex walks
    materialise once, then the overlap test reads them as columns."""
    others, candidates = token_parts(raw)
    staged = df.select("*", others.alias("_tok_others"), candidates.alias("_tok_kw"))
    out = staged.select(*df.columns, combine_tokens(F.col("_tok_others"), F.col("_tok_kw")).alias("tokens"))
    if keywords:
        out = out.withColumn("keywords", keywords_col("tokens"))
    return out


def explode_tokens(df: DataFrame, keep=("file", "line_no")) -> DataFrame:
    """K4: one row per token with its index in the sorted token list.

    The outer form, its empty rows dropped: for the plain one Catalyst infers a test of the
    array and pushes it below the projection, where the walks run again for it, twice.
    """
    return df.select(*keep, F.posexplode_outer("tokens").alias("token_idx", "token")).where("token_idx is not null").select(
        *keep,
        "token_idx",
        F.col("token.start_pos").alias("start_pos"),
        F.col("token.end_pos").alias("end_pos"),
        F.col("token.type").alias("type"),
        F.col("token.value").alias("value"),
    )


def token_at(tokens, pos) -> Column:
    """K5: the first token covering byte ``pos`` (start <= pos < end), else NULL."""
    t = _col(tokens)
    p = pos if isinstance(pos, Column) else F.lit(pos)
    return F.try_element_at(F.filter(t, lambda x: (x["start_pos"] <= p) & (p < x["end_pos"])), F.lit(1))
