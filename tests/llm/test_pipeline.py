"""Each stage of the corpus pipeline against a brute-force version, on the small fixture and rows of every awkward kind."""

from array import array
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lectern.llm import mixing

DDL = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = 'note password="hunter2hunter2" end'
ODD = [
    (None, None, None, None, None), (None, "", "en", "src1", 0), (None, "the cat sat on the mat and was glad of it", "en", None, 1), (900, " \t\n", None, "src1", 3), (900, "12 34 !!", "en", "src1", 8),
    (901, "the dog ran in the park all day long today", "en", "src2", 5), (901, "the dog ran in the park all day long today", "en", "src2", 5), (902, "the cow stood by the gate until the rain had gone", "en", "src2", 5), (902, SECRET, "en", None, 5),
    (903, "word " * 30_000, "en", "src3", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return real.unionByName(spark.createDataFrame(ODD, DDL)).repartition(3).persist()


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mix", "sequence_packing"]


def test_language_id(spark, docs):
    got, every = rows(pipeline.language_id(spark, docs, "")), rows(docs)
    assert got == Counter({r: n for r, n in every.items() if any(c.isalpha() for c in r[1] or "")})


def test_near_dedup(spark, docs):
    every = list(rows(docs).elements())
    shingles = []
    for r in every:
        w = (r[1] or "").encode().lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root, unsure = list(range(len(every))), set()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(shingles):
        for j in range(i):
            same = len(a & shingles[j])
            share = same / (len(a) + len(shingles[j]) - same)
            if share >= 0.86:
                root[top(i)] = top(j)
            elif share >= 0.72:
                unsure |= {i, j}
    groups = {}
    for i in range(len(every)):
        groups.setdefault(top(i), []).append(i)
    left = rows(pipeline.near_dedup(spark, docs, ""))
    assert not left - rows(docs)
    clear = [g for g in groups.values() if not unsure & set(g)]
    assert len(clear) > 100 and any(len(g) > 1 for g in clear)
    for g in clear:
        texts = {every[i] for i in g}
        assert sum(n for r, n in left.items() if r in texts) == 1
        first = min((every[i][0] is None, every[i][0] or 0) for i in g)
        assert next((r[0] is None, r[0] or 0) for r in left if r in texts) == first


def test_secret_scan(spark, docs):
    got = pipeline.secret_scan(spark, docs, "")
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    assert texts[902, 'note [secret]" end'] == 1
    planted = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count()
    assert planted == 0 or got.where(F.col("text").contains("[secret]")).count() >= planted
    assert got.where(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count() == 0
    changed = sum((Counter((r.doc_id, r.text) for r in docs.collect()) - texts).values())
    assert changed == got.where(F.col("text").contains("[secret]")).count()


def test_source_mix(spark, docs):
    got, every = rows(pipeline.source_mix(spark, docs, "")), rows(docs)
    assert set(got) <= set(every) and all(n <= 2 * every[r] for r, n in got.items())
    size = lambda r: len((r[1] or "").encode().split())
    assert all(got[r] == n for r, n in every.items() if size(r) == 0)
    taken = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
    words = Counter()
    for r, n in got.items():
        words[r[3]] += n * size(r)
    assert {r.source: r.n for r in taken} == dict(words)
    # Whole documents, some of 30,000 words: a source is as near as its documents let it be.
    assert all(r.n <= r.target + 1 for r in taken)


def test_sequence_packing(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    pieces = pipeline.sequence_packing(spark, docs, "").collect()
    filled, held = Counter(), {}
    for p in pieces:
        filled[p.sequence_id] += p.length
        held.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    assert max(filled.values()) <= 2048 and sum(len(x) for x in want.elements()) == sum(filled.values())
    for (doc, n), parts in held.items():
        if sum(len(x) for _, x in parts) == 4 * n:  # rows that share id and length are told apart by none of their pieces
            assert want[tuple(array("I", b"".join(x for _, x in sorted(parts))))] >= 1


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path / "some"))
    assert out.count() > 100 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None, None), (1, "12", None, None, 2)], DDL)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, nothing.limit(0), "").columns == nothing.columns
