"""Filter cases: kinds, absent fields, ranges, stacks, candidates, labels."""

import random

from ldaplens.functions.fields import parse_logs
from ldaplens.operators.drill import undo
from ldaplens.operators.filters import Filter, FilterStack, apply_filters

LINES = ["conn=70 op=11", "conn=701", "no keys here", 'dn="cn=ada,o=acme" err=21',
         "2031-07-04T21:14:55.4Z 0x7fb6c2d95640 conn=3 quick fox", 'SRCH base="o=acme"']


def kept(spark, stack, values, fmt="rfc3339"):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line_no long, value string")
    return sorted(r.line_no for r in apply_filters(df, stack, lambda d: parse_logs(d, fmt=fmt)).collect())


def one(kind, value, *ends):
    return FilterStack().push(Filter(kind, value, *ends))


def test_every_kind(spark):
    cases = {("conn", "70"): [0], ("op", "11"): [0], ("dn", "cn=ada,o=acme"): [3], ("err", "21"): [3], ("base", "o=acme"): [5],
             ("thread", "0x7fb6c2d95640"): [4], ("text", "fox"): [4], ("err", "2"): [], ("conn", "x"): []}
    for (kind, value), expected in cases.items():
        assert kept(spark, one(kind, value), LINES) == expected, (kind, value)


def test_ranges_include_their_ends_and_may_be_open(spark):
    values = ["op=9"] * 30
    assert kept(spark, one("op", "9", 4, 7), values) == [4, 5, 6, 7]
    assert kept(spark, one("op", "9", None, 3), values) == [0, 1, 2, 3]
    assert kept(spark, one("op", "9", 27), values) == [27, 28, 29]
    assert kept(spark, one("op", "9"), values) == list(range(30))


def test_a_stack_is_a_conjunction(spark):
    values = ["conn=6 UNBIND", "conn=61 UNBIND", "conn=6 MOD"]
    assert kept(spark, one("conn", "6").push(Filter("text", "UNBIND")), values) == [0]
    assert kept(spark, FilterStack(), values) == [0, 1, 2]


def test_push_pop_clear():
    s = one("op", "2").push(Filter("op", "2"))
    assert len(s) == 2 and len(s.pop()) == 1 and s.clear().empty and s.clear().pop().empty
    assert undo(s).filters == s.filters[:1] and undo(s, whole=True).empty


def test_ranges_intersect():
    s = one("op", "2", 30, 400).push(Filter("base", "b", 80, 200)).push(Filter("err", "1", None, 150)).push(Filter("conn", "4", 90, None))
    assert s.has_range and (s.range_start(), s.range_end()) == (90, 150)
    t = one("text", "a")
    assert not t.has_range and (t.range_start(), t.range_end()) == (0, None)
    assert (one("text", "a", None, 5).range_start(), one("text", "a", 5).range_end()) == (0, None)


def test_candidates(spark):
    df = spark.createDataFrame([(v,) for v in ("x conn=70 y", "x conn=701 y", "x conn=7", "conn=70", "0x7fb6c2d95640", 'dn="a  b"')], "value string")
    got = lambda f: [r[0] for r in df.select(f.candidate()).collect()]
    assert got(Filter("conn", "70")) == [True, False, False, True, False, False]
    assert got(Filter("thread", "0x7fb6c2d95640")) == [False] * 4 + [True, False]
    assert got(Filter("text", "whatever")) == [True] * 6
    assert got(Filter("dn", "a b")) == [False] * 5 + [True]


def test_a_candidate_rejects_no_match(spark):
    """Every line that the exact stack keeps passes the candidate test, blanks and all."""
    rng = random.Random(11)
    blank = lambda: " " * rng.randint(1, 3) + "\t" * rng.randint(0, 1)
    dns = ["a b", "a", "b  a", "é f"]
    values = []
    for _ in range(600):
        head = rng.choice(["6a5b4c3d.00001", "Jul 23 06:07:08", "2031-07-04T21:14:55.4Z", "x"])
        parts = [rng.choice([f"conn={rng.choice([1, 10, 100])}", f'dn="{rng.choice(dns)}"', f'base="{rng.choice(dns)}"', "op=1", "0x7fb6c2d95640"]) for _ in range(rng.randint(0, 4))]
        values.append(head + "".join(blank() + p for p in parts))
    stacks = [one("conn", "1"), one("conn", "10").push(Filter("op", "1")), one("thread", "0x7fb6c2d95640"),
              *[one(k, d) for k in ("dn", "base") for d in dns]]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line_no long, value string")
    whole = parse_logs(df)
    for s in stacks:
        expected = sorted(r.line_no for r in whole.where(s.predicate()).collect())
        assert kept(spark, s, values, "auto") == expected
    assert kept(spark, one("dn", "a b"), ['1.12345 dn="a  b" op=1'], "auto") == [0]  # the blanks are made one


def test_candidates_on_the_tables(spark):
    from ldaplens.sources.derived import event_logs
    p = parse_logs(event_logs(spark, "/root/testdata/sf0.001", "mixed"), as_of="2024-06-30")
    for s in [one("conn", "8"), one("dn", "uid=u46,ou=People,dc=example"), one("base", "ou=g3,dc=example").push(Filter("op", "2"))]:
        assert p.where(s.predicate() & ~s.candidate()).count() == 0


def test_labels():
    assert Filter("err", "68").label() == "err=68"
    assert Filter("text", "fox").label() == "text:fox"
    assert one("err", "68").push(Filter("text", "fox")).label() == "err=68 > text:fox"


def test_equalities_reach_the_scan(spark, tmp_path):
    from ldaplens.sources.codec import write_clustered

    lines = spark.range(20_000).selectExpr("'f' as file", "id as line_no", "concat('conn=', id div 4, ' op=', id % 4, ' x') as value")
    t = write_clustered(parse_logs(lines, fmt="rfc3339"), str(tmp_path / "t"))
    stack = FilterStack().push(Filter("conn", "17")).push(Filter("op", "2"))
    out = apply_filters(t, stack)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conn_id,17)" in plan and "EqualTo(op_id,2)" in plan
    assert [r.line_no for r in out.collect()] == [70]
    assert apply_filters(t, FilterStack().push(Filter("err", "0"))).count() == 0
