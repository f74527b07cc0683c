import random
import struct
import sys
import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402
from ldaplens.llm.quality import quality_rules  # noqa: E402
from test_documents import spans  # noqa: E402
from test_jaccard_join import brute  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8)))
    rows = []
    for i in range(160):
        w = [word() for _ in range(rng.randint(12, 90))]
        kind = i % 8
        if kind == 1 and rows:  # an exact copy, under a larger id
            w = rng.choice(rows)[1].split()
        elif kind == 2 and rows:  # a near copy
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = word()
        elif kind == 3:
            w.insert(5, "password=" + "".join(rng.choices("abc123", k=9)))
        elif kind == 4:  # junk
            w = [x + "%%%" for x in w] if i % 16 == 4 else w[:6] * 9
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    rows += [(500, "", "en", "s0", 0), (501, None, None, None, None), (502, "too short", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def expected(spark, path):
    """The documents that reach the last stage, by brute force on the verdicts of the rules."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules(docs).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    last = {}
    for i in sorted(texts):
        last[texts[i]] = i
    near = brute([(i, t) for t, i in last.items()], 5, 80)
    out = {}
    for i, (_, component) in near.items():
        if component == i:
            t, clean, at = texts[i], "", 0
            for s, _, e in spans(t):
                if s >= at:
                    clean += t[at:s] + "[SECRET]"
                at = max(at, e)
            out[i] = clean + t[at:]
    return docs, texts, last, out


def test_run_equals_brute_force(spark, table):
    docs, texts, last, final = expected(spark, table)
    assert len(texts) < docs.count() and len(last) < len(texts) and len(final) < len(last)
    assert any("[SECRET]" in t for t in final.values())
    got = corpus_pipeline.run(spark, table).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = []
    for i, t in final.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            rows.append((i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)


def test_stages_one_by_one(spark, table, tmp_path):
    _, texts, last, final = expected(spark, table)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "jaccard_join", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    ids = [set(texts), set(last.values()), set(final), set(final)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], ids):
        stage(spark, docs, table).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == COLUMNS
        assert {r["doc_id"] for r in docs.collect()} == want, name


def test_exact_dedup_writes_its_index(spark, table, tmp_path):
    from ldaplens.llm import exact_dedup
    from ldaplens.llm.store import opened

    exact_dedup.drop_indexes()
    docs = spark.read.parquet(f"{table}/documents.parquet")
    kept = corpus_pipeline.exact_dedup(spark, docs, table)
    kept.write.parquet(f"{tmp_path}/kept")
    (root,) = exact_dedup._KEPT
    place, path = opened(f"{root}/v1")
    from pyarrow.fs import FileSelector, FileType

    files = place.get_file_info(FileSelector(path))
    texts = [k for f in files for b in exact_dedup.Directory.load(f"{root}/v1/{f.base_name}").buckets() for chain in b[1].values() for k, *_ in chain]
    assert sorted(texts) == sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/kept").collect())
    exact_dedup.drop_indexes()
    assert place.get_file_info(path).type == FileType.NotFound and not exact_dedup._KEPT
    assert kept.count() == len(texts)  # computed again, it writes its files anew
    exact_dedup._KEPT.append(root)
    exact_dedup.drop_indexes()


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
