import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import language
from lectern.llm.common import crc_mod

DDL = "doc_id long, text string, lang string, score string, lang_pred string"


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.predict(df, crc_mod("doc_id", 3) != 1).collect()}
    held = [r for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [got[r.doc_id].lang_pred == r.lang for r in held]
    assert len(got) == 1000 and np.mean(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in language.identified(df).select("doc_id").collect()}
    assert len(kept) >= 980


def test_edges(spark):
    texts = [None, "", "12 34 !!", "une é", "the cat", "the cat", "ñ", "word " * 300_000]
    rows = [(i, t, "en" if i % 2 else None, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DDL)
    got = {r.doc_id: r for r in language.predict(df, F.lit(True)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[4] [1:] == got[5][1:] and got[6].lang_pred == "en"
    assert {r.lang_pred for r in language.predict(df, F.lit(False)).collect()} == {"und"}
    assert language.predict(df.limit(0), F.lit(True)).count() == 0


def test_long_texts_score_as_one():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << language.BITS, 3))
    t = bytes(rng.integers(32, 250, 3_000_000, dtype=np.uint8))
    whole = language._hashed(b" " + t + b"  ")
    assert np.allclose(language.means([b"a", t, b"bc"], w)[1], w[whole].mean(axis=(0, 1)))
    assert np.allclose(language.means([b"abc", b"", b"de"], w)[2], language.means([b"de"], w)[0])


def test_clean_documents_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = df.where(F.col("lang").isNotNull() & F.col("text").rlike("[A-Za-z]"))
    lost = clean.count() - language.identified(df).where(F.col("lang").isNotNull() & F.col("text").rlike("[A-Za-z]")).count()
    assert lost <= 1
    print("lost", lost, "of", clean.count())
    few = df.limit(50).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    few = few.union(spark.createDataFrame([(-1, None, None), (-2, "12 !", None)], few.schema))
    assert language.identified(few).count() == few.where(F.col("text").rlike(r"\p{L}")).count() > 0


def test_predictions_are_of_the_text_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    model = language.train(language.sampled(df, F.lit(True), 800, "doc_id", "text", "lang"))
    texts = [r.text.encode() for r in df.select("text").collect()]
    texts = [x for t in texts[:60] for x in (t, *t.split()[:8])] + [b"word " * 500_000, b"", b"a", b"\xc3\xb1"]
    rng = np.random.default_rng(7)
    alone = [language.means([t], model.weights[:-1])[0] for t in texts]
    told = [model.predict([t]) for t in texts]
    for _ in range(3):
        order = rng.permutation(len(texts))
        found = language.means([texts[i] for i in order], model.weights[:-1])
        assert all(np.array_equal(found[k], alone[i]) for k, i in enumerate(order))
        names, scores = model.predict([texts[i] for i in order])
        assert all(([names[k]], [scores[k]]) == told[i] for k, i in enumerate(order))


def brute_margins(text, weights):
    line = b" " + bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text) + b"  "
    total = 0
    for i in range(len(line) - 2):
        for gram in (int.from_bytes(line[i : i + 3], "big"), int.from_bytes(line[i : i + 2], "big") | 1 << 24):
            total = total + weights[(gram * 2654435761 & 0xFFFFFFFF) >> 32 - language.BITS]
    return total / (2 * (len(line) - 2))


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = crc_mod("doc_id", 3) != 1
    model = language.train(language.sampled(df, learn, 3200, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.predict(df, learn).collect()}
    few = [r for r in df.where("length(text) < 600 AND text IS NOT NULL").collect()][:40]
    assert len(few) == 40
    for r in few:
        margin = brute_margins(r.text.encode(), model.weights[:-1]) * language._SCALE + model.weights[-1]
        p = [1 / (1 + np.exp(-m * s)) for m, s in zip(margin, model.slopes)]
        f = max(range(len(model.families)), key=lambda i: p[i])
        wins = [0.0] * len(model.languages[f])
        for k, (g, a, b) in enumerate(model.pairs, len(model.families)):
            if g == f:
                wins[a] += p[k]
                wins[b] += 1 - p[k]
        best = max(range(len(wins)), key=lambda i: wins[i])
        share = wins[best] / (len(wins) - 1) if len(wins) > 1 else 1.0
        want = ("und", 0.0) if not language.has_letter(r.text.encode()) else (model.languages[f][best], p[f] / sum(p[: len(model.families)]) * share)
        assert got[r.doc_id].lang_pred == want[0] and abs(got[r.doc_id].score - want[1]) < 1e-5


def test_a_null_id_and_repeats_bound_the_sample(spark):
    df = spark.createDataFrame([(None, "the cat sat", "en")] * 500 + [(1, "le chat est la", "fr")], "doc_id long, text string, lang string")
    rows = language.sampled(df, crc_mod("doc_id", 3) != 1, 100, "doc_id", "text", "lang")
    assert len(rows) <= 200
    assert df.select((crc_mod("doc_id", 3) == 1).alias("x")).where("x IS NULL").count() == 0


def test_a_machine_holds_few_rows_beside_its_own():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 1 << language.BITS), np.float32)
    y = np.where(x[:, 0] > 0.5, 1.0, -1.0)
    tracemalloc.start()
    w, _ = language._machine(x, y, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == x.shape[1] + 1 and peak < x.nbytes / 2


def test_machines_are_fitted_on_a_worker(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(language.sampled(df, F.lit(True), 3200, "doc_id", "text", "lang"))
    held = language.held_against(language.sampled(df, F.lit(True), 4000, "doc_id", "text", "lang"))
    got, own, kind = [], language.fitted, type(df)

    def counted(self, collect=kind.collect):
        rows = collect(self)
        got.extend(len(c) for r in rows for c in r if isinstance(c, (bytes, bytearray)))
        return rows

    def refused(*a):
        raise AssertionError("fitted on the driver")

    found = []
    monkeypatch.setattr(kind, "collect", counted)
    monkeypatch.setattr(language, "_machine", refused)
    monkeypatch.setattr(language, "fitted", lambda *a: found.append(own(*a)) or found[-1])
    language.predict(df, F.lit(True))
    language.identified(df)
    assert 2 * model.weights.nbytes < sum(got) < 2 * model.weights.nbytes + 10_000
    # A driver's BLAS may have more threads, and so another order of its sums.
    assert np.allclose(found[0].weights, model.weights, atol=1e-6) and found[0].languages == model.languages
    assert np.allclose(found[1][0].weights, held[0].weights, atol=1e-6) and abs(found[1][1] - held[1]) < 1e-5
