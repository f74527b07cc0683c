"""Property checks over random lines: token spans slice back to their values,
tokens are sorted, and kept keywords never overlap another token."""

import random

from ldaplens.functions.fields import parse_logs
from ldaplens.functions.tokens import with_tokens

PIECES = ["conn=12", "op=3", 'dn="uid=é,dc=x"', 'filter="(op=1)"', 'base=""', "IP=1.2.3.4:5", "err=49",
          "fd=7", "tag=101", "etime=0.1", "qtime=2", "scope=2", "deref=0", "nentries=9", "attr=cn uid",
          "SEARCH RESULT", "ACCEPT", "BIND", "SRCH", "RESULT", "UNBIND", "closed", "TLS", "method=128",
          "mech=EXTERNAL", "text=", "xBINDy", "stop=4", "ü", "日本", " ", "  ", "\t"]


def test_token_spans_slice_back(spark, lines):
    rng = random.Random(7)
    values = ["".join(rng.choice(PIECES) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(0, 8)))
              for _ in range(400)]
    heads = ["", "2024-01-15T10:30:00.123Z 0x7e19c4d0b3f8 ", "1.12345 0x7e19c4d0b3f8 ", "Nov  9 12:34:56 h "]
    values = [rng.choice(heads) + v for v in values]
    rows = with_tokens(parse_logs(lines(values), as_of="2025-12-01")).select("raw", "tokens").collect()
    for r in rows:
        raw = r.raw.encode("utf-8")
        toks = [(t.start_pos, t.end_pos, t.type, t.value) for t in r.tokens]
        assert [t[0] for t in toks] == sorted(t[0] for t in toks)
        for s, e, kind, value in toks:
            assert raw[s:e].decode("utf-8") == value, (kind, value)
        others = [t for t in toks if t[2] != "KEYWORD"]
        for s, e, kind, value in toks:
            if kind == "KEYWORD" and value != "SEARCH RESULT":
                assert not any(s < oe and os_ < e for os_, oe, _, _ in others)
