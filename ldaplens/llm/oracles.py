"""DuckDB SQL for the operators whose results SQL can express, over whole tables."""

from __future__ import annotations

from ldaplens.llm.quality import LEAST_GROUP, METRICS, SPREADS
from ldaplens.llm.secret_scans import RULES

_GAP, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(rank: int, kind: str) -> str:
    """Rows ``doc_id, start, rank, end`` of one kind; pieces between matches give the places."""
    _, pattern, least = RULES[kind]
    p = _quoted(pattern)
    return f"""
  SELECT doc_id, start, {rank} AS rank, stop FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, vals, gaps,
      coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
      start + length(hits[i]) AS stop
    FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, 1) AS vals,
                 regexp_split_to_array(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})) m) s
  WHERE length(vals[i]) >= {least}"""


OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans(i, k) for i, k in enumerate(RULES))}),
g AS (SELECT doc_id, string_agg(CASE rank {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(RULES))} END
        || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans,
        {", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k}" for i, k in enumerate(RULES))} FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in RULES)},
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

_LEVELS = {"t2": "lang, source, ", "t1": "lang, ", "t0": ""}


def _level(name: str, keys: str) -> str:
    """Quantiles of the merged sketches of one level."""
    return f"""{name} AS (
  SELECT {keys}metric, max(total) AS total, min(top) FILTER (WHERE 100 * below >= 50 * total) AS q50,
         min(top) FILTER (WHERE 100 * below >= 10 * total) AS q10
  FROM (SELECT {keys}metric, ((bucket % 16 + 1) << CAST(bucket // 16 AS BIGINT)) - 1 AS top,
          sum(n) OVER (PARTITION BY {keys}metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys}metric) AS total
        FROM (SELECT {keys}metric, bucket, sum(n) AS n FROM sk GROUP BY ALL) a) b
  GROUP BY {keys}metric)"""


_FLOOR = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in METRICS.items()) + " END"


def _most(t: str) -> str:
    return f"{t}.q50 + greatest({SPREADS} * ({t}.q50 - {t}.q10), {_FLOOR.replace('metric', 't2.metric')})"


OP3 = f"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] || chr(10) || ws[i + 3] || chr(10) || ws[i + 4] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d) e),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) x WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) o GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals
      FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
        n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, n_capitals * 1000 // greatest(n_words, 1) AS capitals FROM m),
l AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, '{k}' AS metric, CAST({k} AS BIGINT) AS x FROM v" for k in METRICS)}),
sk AS (SELECT lang, source, metric, greatest(length(bin(x)) - 4, 0) * 16 + (x >> greatest(length(bin(x)) - 4, 0)) AS bucket, count(*) AS n
       FROM l WHERE n_words > 0 GROUP BY ALL),
{", ".join(_level(n, k) for n, k in _LEVELS.items())},
th AS (SELECT t2.lang, t2.source, t2.metric, CASE WHEN t2.total >= {LEAST_GROUP} THEN {_most('t2')}
         WHEN t1.total >= {LEAST_GROUP} THEN {_most('t1')} ELSE {_most('t0')} END AS most
       FROM t2 JOIN t1 ON t1.lang = t2.lang AND t1.metric = t2.metric JOIN t0 ON t0.metric = t2.metric),
bad AS (SELECT DISTINCT doc_id FROM l JOIN th ON th.lang = l.lang AND th.source = l.source AND th.metric = l.metric WHERE x > most)
SELECT v.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept FROM v LEFT JOIN bad ON bad.doc_id = v.doc_id"""

OP6 = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

# base32 of SHA-1: the digest's 160 bits, five at a time
OP7 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6),
    lambda k: CAST(substr(bits, 5 * i + k, 1) AS INTEGER) << (5 - k)))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p) q"""

OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(0, 4)] AS hs FROM d),
f AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain'
         WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM g"""


def _nearest(name: str, centroids: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(k, CAST(d AS HUGEINT) * 100 + k) AS k, min(d) AS d
  FROM (SELECT rid, vec_id, x, k, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
        FROM v, {centroids}) s GROUP BY rid)"""


def _means(name: str, assigned: str, before: str) -> str:
    """Floors of exact means; an empty cluster keeps its centroid."""
    return f"""{name} AS MATERIALIZED (SELECT b.k, coalesce(m.c, b.c) AS c FROM {before} b LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM (
    SELECT k, i, sum(CAST(y AS HUGEINT)) AS s, CAST(count(*) AS HUGEINT) AS n
    FROM (SELECT k, unnest(x) AS y, unnest(range(1, 65)) AS i FROM {assigned}) u GROUP BY k, i) t GROUP BY k) m ON m.k = b.k)"""


OP13 = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * CAST(e AS DOUBLE)) for e in embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (
  SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 40) s),
{", ".join(_nearest(f"a{i}", f"c{i}") + ", " + _means(f"c{i + 1}", f"a{i}", f"c{i}") for i in range(5))},
{_nearest("z", "c5")},
w AS (SELECT k, sum(CAST(d AS HUGEINT)) AS i FROM z GROUP BY k)
SELECT vec_id, CAST(z.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(w.i AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(i) FROM w) AS BIGINT) AS inertia, sha256(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) for e in c5.c], ',')) AS centroid_sha256
FROM z JOIN w ON w.k = z.k JOIN c5 ON c5.k = z.k"""

ORACLE = {"op2_secret_scans": OP2, "op3_quality_rules": OP3, "op6_exact_dedup": OP6, "op7_warc": OP7, "op12_fill_in_middle": OP12, "op13_centroids": OP13}
