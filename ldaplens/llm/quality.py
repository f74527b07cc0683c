"""Operator 3: quality rules whose thresholds come from mergeable quantile sketches.

A sketch is a histogram of integer values over logarithmic buckets (exact below 16, at most 1/8 apart
above). Sketches merge by adding counts, so Spark's partial aggregation builds them per language and
source in one pass, any order of merging gives the same quantiles, and a source's size does not change
the size of its sketch. A metric's threshold is its group's median plus a multiple of the group's
lower spread, which junk above the median does not move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ldaplens.llm import common

#: Metric -> least distance of its threshold from the median (thousandths: symbols a word, repeated
#: lines of all lines, words in repeated windows of all words, capitals a word).
METRICS = {"symbols": 150, "dup_lines": 300, "repeats": 200, "capitals": 1500}
#: A threshold lies so many lower spreads (median less 10th percentile) above the median at least.
SPREADS = 4
#: A group with fewer documents takes the merged sketch of its language, else that of all documents.
LEAST_GROUP = 100

WINDOW = 5


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``, words in windows found twice or more, from the windows' hashes: sort
    (hash, position), keep positions whose hash equals a neighbour's, and add up what each adds to
    the covered words. Texts without a repeated window are told by their distinct hashes."""
    next_of = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__pairs", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs)).drop("__windows")
    same = F.zip_with("__pairs", next_of("__pairs"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("__at", F.sort_array(F.array_distinct(F.flatten(F.array_compact(same))))).drop("__pairs")
    steps = F.zip_with("__at", next_of("__at"), lambda a, b: F.least(F.lit(WINDOW), b - a))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__at")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the rules and the metrics (``__`` names) of every whole text.

    Windows of five words are compared by 64-bit hashes. Each step is a projection of its own that
    the next one refers to several times, so the word and window arrays are computed once a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD))
    out = docs.withColumns({
        "__words": F.array_remove(F.split(text, common.GAP, -1), ""),
        "__lines": lines,
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "__capitals": F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long"),
    })
    n = F.size("__words")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)),
        "__n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)]))),
    }).drop("__words", "__lines")
    out = _with_repeat_words(out)
    share = lambda part, of: F.floor(F.col(part) * 1000 / F.greatest(F.col(of), F.lit(1))).cast("long")
    return out.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "__symbols": share("n_symbols", "n_words"), "__dup_lines": share("n_dup_lines", "__n_lines"),
        "__repeats": share("n_repeat_words", "n_words"), "__capitals": share("__capitals", "n_words"),
    }).drop("__n_lines")


def sketch(measured: DataFrame, group: list[str]) -> DataFrame:
    """``*group, metric, bucket, n``: the mergeable sketch of every metric in every group."""
    long = measured.where("n_words > 0").select(*group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"__{m}").alias("v")) for m in METRICS])).alias("x"))
    shift = F.greatest(F.length(F.bin("x.v")) - 4, F.lit(0))
    return long.groupBy(*group, F.col("x.metric").alias("metric"), (shift * 16 + F.expr("shiftright(x.v, greatest(length(bin(x.v)) - 4, 0))")).alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """``__lang, __source, t_<metric>...``: one row per language and source."""
    group = ["__lang", "__source"]
    levels = [group, group[:1], []]  # own sketch, the language's, that of all documents
    found = None
    for level in levels:
        merged = sketches.groupBy(*level, "metric", "bucket").agg(F.sum("n").alias("n"))
        key = [*level, "metric"]
        w = W.partitionBy(*key)
        run = merged.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
        top = F.expr("shiftleft(bucket % 16 + 1, cast(bucket div 16 as int)) - 1")
        at = lambda pct: F.min(F.when(100 * F.col("below") >= pct * F.col("total"), top))
        name = f"t{len(level)}"
        least = F.create_map(*[x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v))])
        q = run.groupBy(*key).agg(at(50).alias("q50"), at(10).alias("q10"), F.max("total").alias("total"))
        q = q.select(*key, F.struct("total", (F.col("q50") + F.greatest(SPREADS * (F.col("q50") - F.col("q10")), least[F.col("metric")])).alias("most")).alias(name))
        if found is None:
            found = q
        else:
            found = found.join(q, key)
    most = F.when(F.col("t2.total") >= LEAST_GROUP, F.col("t2.most")).when(F.col("t1.total") >= LEAST_GROUP, F.col("t1.most")).otherwise(F.col("t0.most"))
    return found.select(*group, "metric", most.alias("most")).groupBy(*group).agg(*[F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"t_{m}") for m in METRICS])


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with the rules' counts, ``base_failed`` and ``kept``.

    The measured table is written once, without the text, and the sketches are read from there. With
    ``keep_text`` only the sketches are written and the texts are measured a second time, in a narrow pass: no
    copy of the texts is made. The table of thresholds is written too, so the planner broadcasts it only if
    its true size is under the session's broadcast limit and otherwise joins by language and source
    with skew splitting. Null text: no words, base failed. A null language or source is a group of
    its own. Ids are not used: null or repeated ids and repeated rows are judged row by row. An
    empty table gives no rows.
    """
    group = {f"__{k}": F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in (("lang", lang_col), ("source", source_col))}
    found = features(docs, text_col).withColumns(group)
    measured = found if keep_text else common.written(found.drop(text_col), "quality")
    sketches = sketch(measured, list(group))
    limits = common.written(thresholds(common.written(sketches, "quality-sketches") if keep_text else sketches), "quality-limits")
    passes = F.lit(True)
    for m in METRICS:
        passes = passes & (F.col(f"__{m}") <= F.coalesce(F.col(f"t_{m}"), F.col(f"__{m}")))
    return measured.join(limits, list(group), "left").withColumn("kept", ~F.col("base_failed") & passes)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every document; edge cases as in ``judged``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return judged(slim, keep_text=False).select("doc_id", *COUNTS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with exactly its columns."""
    columns = docs.columns
    # the operator's own columns must not meet columns of the same name: carry the input in a struct
    held = docs.select(F.struct(*columns).alias("__row"), "text", "lang", "source")
    found = judged(held.select("__row", F.col("text").alias("__text"), "lang", "source"), "__text")
    # no plain conjunction: its half on the counts would be pushed below them and count everything twice
    return found.where(F.when(F.col("kept"), 1).otherwise(0) * F.size(F.array("n_words")) == 1).select(*[F.col("__row")[c].alias(c) for c in columns])
