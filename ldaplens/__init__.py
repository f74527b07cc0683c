"""ldaplens: Spark-native analytics for LDAP directory-server (slapd) logs.

Log files become a typed DataFrame (one row per line); the interactive
gestures of a log viewer become set-at-a-time DataFrame operators:
stacked filters, drill-down joins from many seed tokens, connection ranges,
numbered search, paging, and a Structured Streaming follow source.
"""

from ldaplens.functions.timestamps import LOG_FORMATS, normalize_frame
from ldaplens.functions.fields import parse_logs, with_fields
from ldaplens.functions.tokens import tokens_col, with_tokens, explode_tokens, token_at, keywords_col
from ldaplens.operators.filters import Filter, FilterStack, apply_filters
from ldaplens.operators.drill import conn_ranges, conn_lines, visible_counts, drill, drill_keys
from ldaplens.operators.search import (
    first_match_pos, match_count, query_from_token, search, search_many, search_numbered, search_spans,
)
from ldaplens.operators.paging import with_ordinal, page, goto, first_last, line_status
from ldaplens.sources.text import read_logs, with_line_no, line_counts, slice_lines, tail_lines
from ldaplens.sources.codec import detect_codec, read_compressed, ingest_logs
from ldaplens.streaming.follow import follow_logs, follow_into_table, new_line_count
from ldaplens.streaming.table import compact, read_table
from ldaplens.streaming.stream import stream_lines, parse_stream, run_to_parquet

__all__ = [
    "normalize_frame", "LOG_FORMATS", "parse_logs", "with_fields",
    "tokens_col", "with_tokens", "explode_tokens", "token_at", "keywords_col",
    "Filter", "FilterStack", "apply_filters",
    "conn_ranges", "conn_lines", "visible_counts", "drill", "drill_keys",
    "search", "search_numbered", "search_spans", "search_many", "first_match_pos", "match_count",
    "query_from_token",
    "with_ordinal", "page", "goto", "first_last", "line_status",
    "read_logs", "with_line_no", "line_counts", "slice_lines", "tail_lines",
    "detect_codec", "read_compressed", "ingest_logs",
    "follow_logs", "follow_into_table", "new_line_count", "compact", "read_table",
    "stream_lines", "parse_stream", "run_to_parquet",
]
