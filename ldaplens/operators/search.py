"""Literal search over the visible set (Q1-Q6).

Search tests the *original* line (``value``), not the normalised one; the
query is a case-sensitive literal. Matches are numbered per file with the
same bucketed ordinal as paging, so no file is funnelled through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ldaplens.functions.tokens import match_spans
from ldaplens.operators.paging import DEFAULT_BUCKET, bucket_of


def java_quote(text: str) -> str:
    """A Java regex matching ``text`` literally."""
    if "\\E" not in text:
        return "\\Q" + text + "\\E"
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in text)


def search(visible: DataFrame, query: str, value: str = "value") -> DataFrame:
    """Q1: visible lines containing ``query``; an empty query finds nothing."""
    if not query:
        return visible.where(F.lit(False))
    return visible.where(F.col(value).contains(F.lit(query)))


def match_count(visible: DataFrame, query: str) -> DataFrame:
    """A4: number of matching lines per file."""
    return search(visible, query).groupBy("file").agg(F.count(F.lit(1)).alias("n_matches"))


def search_numbered(visible: DataFrame, query: str, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Q2/Q3: each match with its visible ordinal ``ord``, ``match_ord``, ``n_matches``, the wrapped
    ``next_match_ord`` / ``prev_match_ord`` and the lines they are on, ``next_line_no`` /
    ``prev_line_no``.

    Two reads of ``visible`` and one small table: per ``(file, bucket)`` its visible
    lines, its matches and its first and last match. Running sums over the
    buckets give where each bucket's numbers start; row numbers, next and previous
    match are found inside a bucket, and at its ends taken from the table. ``ord`` is
    kept if ``visible`` has it.
    """
    if not query:
        return visible.where(F.lit(False)).select(*[c for c in visible.columns if c != "ord"], *[
            F.lit(0).cast("bigint").alias(c) for c in ("ord", "match_ord", "n_matches", "next_match_ord",
                                                       "prev_match_ord", "next_line_no", "prev_line_no")])
    hit = F.col("value").contains(F.lit(query))
    tagged = visible.withColumns({"_bucket": bucket_of("line_no", bucket), "_hit": F.coalesce(hit, F.lit(False)).cast("int")})
    at_hit = F.when(F.col("_hit") == 1, F.col("line_no"))
    sizes = tagged.groupBy("file", "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_hits"), F.min(at_hit).alias("_first"), F.max(at_hit).alias("_last"))
    before = Window.partitionBy("file").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("file")
    starts = sizes.select(
        "file", "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ord0"),
        F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_match0"),
        F.sum("_hits").over(whole).alias("n_matches"),
        F.coalesce(F.min("_first").over(after), F.min("_first").over(whole)).alias("_next"),
        F.coalesce(F.max("_last").over(before), F.max("_last").over(whole)).alias("_prev"),
    )
    inside = Window.partitionBy("file", "_bucket").orderBy("line_no")
    ranked = tagged.withColumn("_rn", F.row_number().over(inside)).where(F.col("_hit") == 1)
    ranked = ranked.withColumns({
        "_m": F.row_number().over(inside), "_lead": F.lead("line_no").over(inside), "_lag": F.lag("line_no").over(inside)})
    k, n = F.col("_match0") + F.col("_m") - 1, F.col("n_matches")
    ord_ = F.col("ord") if "ord" in visible.columns else F.col("_ord0") + F.col("_rn") - 1
    return ranked.join(starts, ["file", "_bucket"]).select(
        *[c for c in visible.columns if c != "ord"], ord_.alias("ord"),
        k.alias("match_ord"), "n_matches", ((k + 1) % n).alias("next_match_ord"), ((k + n - 1) % n).alias("prev_match_ord"),
        F.coalesce("_lead", "_next").alias("next_line_no"), F.coalesce("_lag", "_prev").alias("prev_line_no"),
    )


def first_match_pos(query: str, value: str = "value") -> Column:
    """Q4: byte offset of the first hit in the original line (NULL when none)."""
    v = F.col(value)
    return F.when(v.contains(F.lit(query)), F.octet_length(F.substring_index(v, query, 1)))


def search_spans(query: str, value: str = "value") -> Column:
    """Q5: non-overlapping ``(start_pos, end_pos)`` byte spans of every hit, left to right."""
    q_len = len(query.encode("utf-8"))
    return F.transform(
        match_spans(F.col(value), java_quote(query)),
        lambda x: F.struct(x["s"].alias("start_pos"), (x["s"] + F.lit(q_len)).alias("end_pos")),
    )


def search_span_rows(df: DataFrame, query: str, keys=("file", "line_no"), value: str = "value") -> DataFrame:
    """Q5 as rows ``(keys..., span_idx, start_pos, end_pos)``, linear in the hits.

    The anchored walk yields each hit with the gap before it; a running sum
    of their byte lengths (a window per line, over that line's hits only)
    gives each hit's end. Prefer this to ``search_spans`` when a line can hold
    many hits: the array form re-builds its running total per hit.
    """
    if not query:
        return df.where(F.lit(False)).select(*keys, F.lit(0).alias("span_idx"),
                                             F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"))
    q_len = len(query.encode("utf-8"))
    walk = "\\G(?s:.*?)(" + java_quote(query) + ")"
    hits = search(df, query, value).select(
        *keys, F.posexplode(F.regexp_extract_all(F.col(value), F.lit(walk), 0)).alias("span_idx", "_walked"))
    w = Window.partitionBy(*keys).orderBy("span_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.octet_length("_walked")).over(w).cast("int")
    return hits.select(*keys, "span_idx", (end - q_len).alias("start_pos"), end.alias("end_pos"))


def query_from_token(tok: Column) -> Column:
    """Q6: conn/op/err -> the digits, dn -> the quoted body, thread -> the id, else ''."""
    t = tok["type"]
    v = tok["value"]
    return (
        F.when(t == "CONN_ID", F.substring(v, 6, 1 << 30))
        .when(t == "OP_ID", F.substring(v, 4, 1 << 30))
        .when(t == "ERROR_CODE", F.substring(v, 5, 1 << 30))
        .when(t == "DN_VALUE", F.regexp_extract(v, '(?s)^dn="(.*)"$', 1))
        .when(t == "THREAD_ID", v)
        .otherwise(F.lit(""))
    )


def search_many(visible: DataFrame, queries: DataFrame, value: str = "value") -> DataFrame:
    """Q6 in bulk: ``queries`` is ``(file, query)`` (e.g. ``query_from_token`` of many
    seeds); returns the visible lines containing a query of their file, with
    the ``query``: one row per (line, matching query), see ``substring_join``."""
    from ldaplens.operators.pieces import substring_join

    needles = queries.select("file", F.col("query").alias("_needle"))
    return substring_join(visible, needles, value).withColumnRenamed("_needle", "query")
