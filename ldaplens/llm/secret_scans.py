"""Operator 2: secret scans over an incremental ledger of content-addressed blobs.

Every version of a document is addressed by the SHA-256 of its text. A blob is scanned once per rule
version, however many paths or times it comes; pairs of blob and rule version that the ledger already
has are left out. The ledger is a folder with a part for each batch (``record``); findings are joined back
to all paths (``join_back``). All steps are DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ldaplens.llm import common


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: kind -> (version, pattern, group whose length counts, least characters), in the order of kinds.
#: Runs shorter than the least length cannot hide a longer match in the two last patterns, so
#: their least length is part of the pattern; an assignment must be matched first and dropped later.
RULES = {
    "assign": ("assign/1", rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    "access": ("access/1", r"(AKIA[A-Z0-9]{16,})", 20),
    "hex": ("hex/1", r"([0-9a-f]{24,})", 24),
}

#: One match as the ledger keeps it: kind, its number among the kind's matches of the blob,
#: characters since the match before, characters of the match and of its group 1.
MATCHES = "array<struct<rank:int,i:int,gap:int,len:int,value:int>>"

#: start first, so that it sorts; code points, end exclusive; ``reach``: the largest end so far.
SPANS = "array<struct<start:int,rank:int,end:int,reach:int>>"

LEDGER = f"blob string, versions array<string>, matches {MATCHES}"


def matches(text: Column, pattern: str, rank: int) -> Column:
    """All leftmost, non-overlapping matches. The gaps between them come from ``split`` on the same
    pattern; a text without a match is told by one test."""
    hits, values, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), 1), F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["hit"]).alias("len"), F.length(m["value"]).alias("value")))
    one = lambda s, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), s["gap"].alias("gap"), s["len"].alias("len"), s["value"].alias("value"))
    return F.when(text.rlike(pattern), F.transform(sizes, one)).otherwise(F.array().cast(MATCHES))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """New ledger rows ``blob, versions, matches``: one for each distinct text with rule versions
    that ``ledger`` does not have for it. ``docs``: ``doc_id, text`` without nulls in text.

    Equal texts meet before the shuffle (partial aggregation by blob), so a text that a third of all
    rows share costs one row a task.
    """
    rules = RULES if rules is None else rules
    blobs = docs.select(F.sha2("text", 256).alias("blob"), "text").distinct()
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    known = F.coalesce("seen", F.array().cast("array<string>"))
    todo = blobs.withColumn("versions", F.array_except(F.array(*[F.lit(v) for v, _, _ in rules.values()]), known)).where(F.size("versions") > 0)
    none = F.array().cast(MATCHES)
    parts = [F.when(F.array_contains("versions", v), matches(F.col("text"), p, rank)).otherwise(none) for rank, (v, p, _) in enumerate(rules.values())]
    return todo.select("blob", "versions", F.concat(*parts).alias("matches"))


def findings(ledger: DataFrame, rules: dict | None = None) -> DataFrame:
    """``blob, found`` for blobs with findings under ``rules``' versions; those of other versions are
    passed over, and a pair that is in the ledger twice counts once. Running sums of gaps and lengths give
    the places, then matches with a short value are dropped. Linear in the number of matches."""
    rules = RULES if rules is None else rules
    version = F.array(*[F.lit(v) for v, _, _ in rules.values()])
    each = ledger.select("blob", "versions", F.explode("matches").alias("m")).where(F.array_contains("versions", F.get(version, F.col("m.rank")))).select("blob", "m.*")
    each = each.dropDuplicates(["blob", "rank", "i"])
    by_kind = W.partitionBy("blob", "rank").orderBy("i")
    least = F.create_map(*[x for rank, (_, _, n) in enumerate(rules.values()) for x in (F.lit(rank), F.lit(n))])
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(by_kind).cast("int")).where(F.col("value") >= least[F.col("rank")]).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.withColumn("reach", F.max("end").over(W.partitionBy("blob").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)))
    span = F.struct("start", "rank", "end", F.coalesce("reach", F.lit(0)).alias("reach"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(paths, ledger)``: ``doc_id, blob, found`` of every row, and the ledger with the new blobs.

    Findings are joined back by blob; the written findings are as small as the secrets are rare, and
    the planner broadcasts them only if their measured size allows, else it splits skewed blobs.
    Null or empty text: no findings. Null ids stay null, repeated rows give repeated results, an
    empty table gives no rows, other columns are ignored.
    """
    paths = common.texts(docs, id_col, text_col)
    new = common.written(scan_new(paths, ledger), "ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return join_back(docs, whole, id_col=id_col, text_col=text_col), whole


def join_back(docs: DataFrame, ledger: DataFrame, rules: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, found`` of every row, from a ledger that has all its texts; nothing is scanned."""
    found = common.written(findings(ledger, rules), "findings")
    joined = common.texts(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("blob")).join(found, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def read_ledger(spark: SparkSession, place: str) -> DataFrame:
    """All finished parts of the ledger in the shared folder ``place``; no rows before the first one."""
    from pyarrow import fs

    from ldaplens.llm.store import opened

    files, root = opened(place)
    parts = [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-")]
    done = [p for p, mark in zip(parts, files.get_file_info([f"{root}/{p}/_SUCCESS" for p in parts])) if mark.type == fs.FileType.File]
    if not done:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[f"{place.rstrip('/')}/{p}" for p in sorted(done)])


def record(docs: DataFrame, place: str, rules: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger in ``place`` lacks of ``docs``, add it there as one part, and return the whole ledger.

    A part counts once it is whole, so a batch that failed is simply recorded again; two batches at a time
    may both scan a blob, which ``findings`` counts once. Null text is empty, an empty table adds no rows.
    """
    spark = docs.sparkSession
    new = scan_new(common.texts(docs, id_col, text_col), read_ledger(spark, place), rules)
    new.write.parquet(f"{place.rstrip('/')}/part-{uuid.uuid4().hex}")
    return read_ledger(spark, place)


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, or union of overlapping spans, replaced by ``mark``; columns, other
    values and rows without findings are unchanged, a null text stays null."""
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = common.written(findings(common.written(scan_new(held.select("text")), "ledger")), "findings")
    text = F.col("text")
    parts = F.transform("found", lambda s: F.when(s["start"] >= s["reach"], F.concat(F.substring(text, s["reach"] + 1, s["start"] - s["reach"]), F.lit(mark))).otherwise(F.lit("")))
    last = F.array_max(F.transform("found", lambda s: s["end"]))
    clean = F.when(F.col("found").isNotNull(), F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))).otherwise(F.col("__row")[text_col])
    joined = held.withColumn("blob", F.sha2("text", 256)).join(found, "blob", "left")
    return joined.select(*[(clean if c == text_col else F.col("__row")[c]).alias(c) for c in columns])


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of ``scan_secrets``' rows."""
    kinds = F.array(*[F.lit(k) for k in RULES])
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(RULES)], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
