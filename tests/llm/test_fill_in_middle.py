import re
from collections import Counter
from hashlib import sha256

import pytest

from ldaplens.llm import fill_in_middle as fim
from ldaplens.llm.fill_in_middle import MARKS, Restorer, assembled, fill_in_middle


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha256(b"7:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    whole = sha256(text.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text):
        return doc_id, len(units), "plain", None, None, whole, whole
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha256(out.encode()).hexdigest(), whole


LINES = ["\n", "\n\n\nx", "a\nb\nc\nd", "a\nb\nc\nd\n", "<P", "<\nP>\n<", "has <S> in it\nx", "é😀\n" * 7 + "<<\n<", "<P\n>\n<M\n", "one line"]


@pytest.fixture()
def texts(spark, odd):
    rows = [(100 + 10 * i + j, t, "en", "s0", 1, 1, "k", 2) for i, t in enumerate(LINES) for j in range(10)]
    rows += [(500, "two texts\n", "en", "s0", 1, 1, "k", 2), (500, "one id\nb", "en", "s0", 1, 1, "k", 2)]
    return odd.union(spark.createDataFrame(rows, odd.schema))


@pytest.mark.parametrize("piece", [3, 16_384])
def test_every_row(texts, piece, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", piece)
    rows = texts.where("length(text) < 1500 or text is null") if piece == 3 else texts
    got = Counter(tuple(r) for r in fill_in_middle(rows).collect())
    assert got == Counter(expected(r["doc_id"], r["text"]) for r in rows.collect())
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}


def test_a_third_of_all_rows_is_one_document(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, -7, id) as doc_id", "if(id % 3 = 0, 'hot\ntext\nagain', concat(id, '\nb\n')) as text").repartition(4)
    assert assembled(rows).where("doc_id = -7 and pos >= 0").count() <= 4 * 6
    got = fill_in_middle(rows).groupBy("doc_id").count().where("count > 1").collect()
    assert [tuple(r) for r in got] == [(-7, 3000)]


def test_copies_sent_again_after_the_memo_is_full(spark, monkeypatch):
    monkeypatch.setattr(fim, "MEMO", 2)
    rows = [(i % 5, f"text {i % 5}\nline\n") for i in range(50)]
    got = Counter(tuple(r) for r in fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect())
    assert got == Counter(expected(*r) for r in rows)


def test_one_long_line_and_many_lines(spark):
    rows = [(1, "x" * 3_000_000), (2, "ab\n" * 500_000), (3, "é" * 40_000 + "\n" + "y" * 40_000)]
    got = {r["doc_id"]: tuple(r) for r in fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: expected(i, t) for i, t in rows}


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_restorer_finds_marks_over_piece_borders():
    for form, order in (("psm", "PSM"), ("spm", "SPM")):
        parts = {"P": "a<\n<S", "S": "<<M", "M": "<P\n>"}
        out = "".join(f"<{m}>{parts[m]}" for m in order)
        for size in range(1, 8):
            one, back = Restorer(form), ["", "", ""]
            for i in range(0, len(out), size):
                for place, piece in one.feed(out[i:i + size]):
                    back[place] += piece
            for place, piece in one.rest():
                back[place] += piece
            assert back == [parts["P"], parts["M"], parts["S"]]
    assert set(MARKS.values()) == {"<P>", "<S>", "<M>"}
